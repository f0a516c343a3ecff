"""Methods against brute force: fences, tiling, tree decoding, lattices, selection; and the odd tables of every stage."""

import itertools
import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tempestry.llm import bitmaps, boosting, decontamination, extraction, jaccard, packing, privacy, quality, substrings, toxicity
from tempestry.llm.common import discard

#: Names that the operators use inside, as further columns of a table.
CLASHES = (
    "_lang _source _t _w _h _g _r _l _n_lines n_lines fence_symbols fence_word_length_low kept n_words base_failed first class node root n_links n_copies class_id _md5 _node _class "
    "row number bucket padded_to shard batch place n_tokens _place at print leak leak_print item h spans start kind score lost body n_bytes"
).split()


def clashing(spark, rows):
    """documents (doc_id, text, lang, source) with every clashing name as a further column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHES) for r in rows], schema)


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words):04d}" for _ in range(n))


# ---- quality ---------------------------------------------------------------------------------------


def varied(rng, n, spread):
    """A text of n words whose mean length varies with the document."""
    size = 5 + rng.uniform(-spread, spread)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(size, 0.2))))) for _ in range(n))


def test_fences_follow_the_spread_of_the_source(spark):
    rng = random.Random(1)
    rows = [(i, varied(rng, 100, 0.1), "en", "narrow") for i in range(80)] + [(100 + i, varied(rng, 100, 2.0), "en", "wide") for i in range(80)]
    odd = " ".join("x" * 8 for _ in range(50)) + " " + " ".join(f"{k:08d}" for k in range(60))
    rows += [(200, odd, "en", "narrow"), (201, odd, "en", "wide")]
    got = {r.doc_id: r for r in quality.with_verdict(clashing(spark, rows), quality.QualityParams(max_repeat_pct=60)).collect()}
    assert got[200].fence_word_length < 8 < got[201].fence_word_length
    assert not got[200].base_failed and (got[200].kept, got[201].kept) == (False, True)


def outliers(rng):
    """rule -> a text of 120 words or more that passes the base rule and breaks that rule alone."""
    base = prose(rng, 120).split()
    lines = "\n".join(["a1 b1", *[f"{w}\nz{k} y{k}" if k % 2 else f"{w}\na1 b1" for k, w in enumerate(base)]])
    return {
        "symbols": " ".join(f"{w}#" if k % 3 == 0 else w for k, w in enumerate(base)),
        "dup_lines": lines,
        "repeats": " ".join([*base[:70], *base[:35], *base[70:]]),
        "word_length": " ".join(w + "abcdefgh" for w in base),
        "word_length_low": " ".join(w[1:3] if k % 10 else w for k, w in enumerate(f"q{rng.randrange(9)}{rng.randrange(9)}" for _ in range(160))),
    }


@pytest.mark.parametrize("rule", ["symbols", "dup_lines", "repeats", "word_length", "word_length_low"])
def test_each_rule_rejects_an_outlier_even_beside_junk(spark, rule):
    rng = random.Random(2)
    clean = [(i, "\n".join(prose(rng, 6) for _ in range(20)), "en", "s") for i in range(90)]
    odd = outliers(rng)[rule]
    rows = [*clean, *[(1000 + i, odd + f" tail{i:03d}", "en", "s") for i in range(30)]]  # a quarter of the source
    got = {r.doc_id: r for r in quality.with_verdict(clashing(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.kept} == set(range(90))
    assert not any(r.base_failed for r in got.values())


def test_small_sources_use_their_language(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 100), "en", "big") for i in range(60)] + [(100, prose(rng, 100), "en", "small"), (101, prose(rng, 100), None, None)]
    got = {r.doc_id: r for r in quality.with_verdict(clashing(spark, rows)).collect()}
    assert got[100].fence_symbols == pytest.approx(got[0].fence_symbols, rel=0.03) and got[101].fence_symbols is not None and got[101].kept


# ---- decontamination -------------------------------------------------------------------------------


def brute_tiles(doc, item, k):
    """Greedy tiles by comparing all places, longest first; of equal ones the first in the document, then the item."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n >= k and n > best[0]:
                    best = (n, a, b)
        if not best[0]:
            return sorted(out)
        n, a, b = best
        out.append((a, b, n))
        free_d[a : a + n] = [False] * n
        free_i[b : b + n] = [False] * n


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randrange(1, 4)
        doc, item = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        code = lambda s, j: hash(tuple(s[j : j + k]))
        at, at_item = decontamination.matches(
            np.array([code(doc, j) for j in range(len(doc) - k + 1)], np.int64), np.arange(max(len(doc) - k + 1, 0)), np.array([code(item, j) for j in range(len(item) - k + 1)], np.int64), np.arange(max(len(item) - k + 1, 0))
        )
        assert sorted(decontamination.tiles(at, at_item, k)) == brute_tiles(doc, item, k), (doc, item, k)


def brute_pairs(docs, items, k=5, share=0.6):
    out = set()
    for (i, t), (j, u) in itertools.product(enumerate(docs), enumerate(items)):
        doc, item = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (t, u))
        if item and sum(n for _, _, n in brute_tiles(doc, item, min(k, len(item)))) >= share * len(item):
            out.add((i, j))
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    phrase = "which of the following is true"  # in every item and in most documents
    items = [f"{phrase} {prose(rng, rng.randrange(4, 30), 60)}" for _ in range(12)] + ["one two", "solo", "ja ja ja ja ja ja ja ja ja", "", None]
    docs = []
    for n in range(60):
        text = prose(rng, 40, 60).split()
        if n % 2:
            text += phrase.split()
        if n % 3 == 0:
            w = rng.choice(items[:12]).split()
            cut = rng.randrange(len(w))
            text = w[cut:] + text[:20] + w[:cut] + text[20:]
        docs.append(" ".join(text))
    docs += ["One, two!", "a solo b", "ja " * 200, None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(0, docs[0])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(rows, bench).collect()}
    assert got == brute_pairs(docs, items)
    dirty = {i for i, _ in got}
    assert {r.doc_id for r in decontamination.clean(rows, bench).collect()} == set(range(len(docs))) - dirty


def test_scripts_without_spaces(spark):
    item = "鉄道の駅は町の中心にある"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"昨日。{item}と言った"), (2, "中心にある町の駅は鉄道"), (3, "別の文です"), (None, item), (None, "無関係な文")], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(rows, bench).collect()} == {1, None}
    assert sorted(r.text for r in decontamination.clean(rows, bench).collect()) == sorted(["中心にある町の駅は鉄道", "別の文です", "無関係な文"])


# ---- extraction ------------------------------------------------------------------------------------


def test_tree_decoding_equals_enumeration():
    rng = random.Random(6)
    for _ in range(200):
        nodes = [extraction.Node("html", "", None)]
        for _ in range(rng.randrange(1, 9)):
            parent = rng.choice(nodes)
            child = extraction.Node("div", "", parent)
            parent.children.append(child)
            nodes.append(child)
        # page order: parents before children, as parsing gives them
        for k, n in enumerate(nodes):
            n.number = k
        p = np.array([rng.uniform(0.02, 0.98) for _ in nodes])
        kept = extraction.decode(nodes, p)
        value = lambda c: sum(math.log(p[k] if x else 1 - p[k]) for k, x in enumerate(c) if k)
        allowed = [c for c in itertools.product([False, True], repeat=len(nodes)) if c[0] and all(not c[n.number] or c[n.parent.number] for n in nodes[1:])]
        assert value(tuple(kept)) == pytest.approx(max(map(value, allowed)))
        assert tuple(kept) in allowed


# ---- toxicity --------------------------------------------------------------------------------------


def readings_by_enumeration(arcs, model, codes):
    """The cost of the cheapest path through a lattice of (letter, times, cost)."""
    best = math.inf
    for path in itertools.product(*arcs):
        cost = sum(x[2] for x in path)
        word = "".join(x[0] * x[1] for x in path) + " "
        a = b = 0
        for c in word:
            z = int(codes[ord(c)])
            cost -= float(model[a, b, z])
            a, b = b, z
        best = min(best, cost)
    return best


def test_viterbi_equals_enumeration(spark):
    plain = spark.createDataFrame([("the people in the town walk to the river and some idiot stands there",)], "text string")
    model, codes = toxicity.language_model(plain), toxicity.codes()
    rng = random.Random(7)
    for _ in range(200):
        word = "".join(rng.choice("idot10!|.s5 -") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 7)))
        arcs = toxicity.lattice(word)
        cost, read = toxicity.cheapest(arcs, model)
        assert cost == pytest.approx(readings_by_enumeration(arcs, model, codes), abs=1e-3), word
        assert toxicity.restore(word, model) == read.strip()


# ---- privacy ---------------------------------------------------------------------------------------


def test_selection_equals_a_plain_loop(spark):
    model = privacy.fit(spark.createDataFrame([(f"some words of text {k} here",) for k in range(12)], "text string"))
    rng = random.Random(8)
    pool = ["(277) 555-6688", "joe [at] mail [dot] com", "a.b@mail.org", "10.0.0.1", "2001:db8::1", "4111 1111 1111 1111", "+1 277 555 6687", "277-555-6688", "1999-02-03 12", "4111.1111.1111.1111", "x at y dot com", "word"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", ", ", ""]) for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    got = privacy._select(texts, model)
    for text, spans in zip(texts, got):
        chosen = [(k, a, b, True) for k, a, b in privacy.base_spans(text)]
        found = privacy.candidates(text)
        base = list(chosen)
        found = [c for c in found if all(c[2] <= a or c[1] >= b for _, a, b, _ in base)]
        scores = boosting.predict(model, np.array([privacy.features(text, *c) for c in found], float)) if found else []
        for j in sorted(range(len(found)), key=lambda j: -scores[j]):
            kind, a, b = found[j]
            if scores[j] >= model["limits"][privacy.KINDS.index(kind)] and all(b <= x or a >= y for _, x, y, _ in chosen):
                chosen.append((kind, a, b, False))
        assert sorted((s["kind"], s["start"], s["end"], s["base"]) for s in spans) == sorted(chosen), text
    for kind, seen in model["held_out"].items():
        assert seen["precision"] is None or seen["precision"] >= 0.98, (kind, seen)
        assert seen["recall"] >= 0.8, (kind, seen)


def test_further_forms_are_proposed(spark):
    model = privacy.fit(spark.createDataFrame([(f"some words of text {k} here",) for k in range(12)], "text string"))
    texts = ["mail joe at mail dot com now", "write joe [At] mail [Dot] org", "host 2001:db8::1 is up", "look at this dot and go", "std::vector and a::b at 12::30"]
    assert [[s["kind"] for s in spans] for spans in privacy._select(texts, model)] == [["email"], ["email"], ["ip"], [], []]


def test_national_and_short_forms_are_selected(spark):
    model = privacy.fit(spark.createDataFrame([(f"some words of text {k} here",) for k in range(12)], "text string"))
    texts = ["ring tel 0171 2345678 today", "ring 0049 30 1234567 today", "the host fe80::1 is up", "page 12 3456789 of it"]
    found = [[(s["kind"], t[s["start"] : s["end"]]) for s in spans] for t, spans in zip(texts, privacy._select(texts, model))]
    assert found == [[("phone", "0171 2345678")], [("phone", "0049 30 1234567")], [("ip", "fe80::1")], []]


def test_the_score_decides_between_overlapping_kinds():
    # one run of digits is proposed as a phone and as a card, with the same bounds: the better score of the two counts
    text = "pay 4111.1111.1111.111 now"
    found = privacy.candidates(text)
    kinds = {k for k, a, b in found if text[a:b] == "4111.1111.1111.111"}
    assert kinds >= {"phone", "card"}
    width = len(privacy.features(text, *found[0])) - 1
    x = np.array([[privacy.KINDS.index(k)] + [0.0] * width for k in ("phone", "card") for _ in range(200)])
    for better in ("phone", "card"):
        y = np.array([int(k == better) for k in ("phone", "card") for _ in range(200)])
        model = boosting.fit(x, y)
        model["limits"] = [0.5] * 4
        assert [s["kind"] for s in privacy._select([text], model)[0]] == [better]


def test_a_left_out_family_is_judged_by_a_model_without_it(spark):
    docs = spark.createDataFrame([(f"some words of text {k} here",) for k in range(12)], "text string")
    got = privacy.left_out(docs, families=["three groups", "date"])
    assert got["three groups"]["look_alike"] is None and got["date"]["personal"] is None
    x, y, held, family = privacy._material(docs, privacy.PrivacyParams())
    assert got["date"]["rows"] == (family == "date").sum() and held.any()
    own = family != "date"
    model = privacy._fitted(x[own], y[own], held[own], privacy.PrivacyParams())
    chosen = boosting.predict(model, x[~own]) >= model["limits"][privacy.KINDS.index("phone")]
    assert got["date"]["look_alike"] == chosen.mean()  # no bound on it: an unseen form may go wrong, as the README says


# ---- packing ---------------------------------------------------------------------------------------


def test_optimum_is_exact_beyond_any_length(spark):
    rng = random.Random(9)
    lengths = [rng.randrange(1, 30000) for _ in range(40)]
    rows = spark.createDataFrame([(k if k % 3 else None, n) for k, n in enumerate(lengths)], "doc_id long, n_tokens long")
    p = packing.PackingParams(buckets=3, token_budget=65536, shard_docs=4)
    got = packing.packed(rows, p).collect()
    waste = sum(r.padded_to - r.n_tokens for r in got)
    ends = sorted(set(lengths))
    want = min(sum(min(b for b in (*c, ends[-1]) if b >= n) - n for n in lengths) for c in itertools.combinations(ends[:-1], 2))
    assert waste == want and len({(r.bucket, r.shard, r.batch, r.place) for r in got}) == 40


# ---- substrings ------------------------------------------------------------------------------------


def test_identifiers_tell_sixteen_bytes_apart():
    rng = np.random.RandomState(0)
    x = rng.randint(0, 3, 4000).astype(np.uint8)
    ids = substrings.identifiers(x)
    first: dict = {}
    for i in range(len(x) - 64):
        b = x[i : i + 32].tobytes()
        assert first.setdefault((int(ids["a32"][i]), int(ids["b32"][i])), b) == b
        assert first.setdefault(b, (int(ids["a32"][i]), int(ids["b32"][i]))) == (int(ids["a32"][i]), int(ids["b32"][i]))


def test_substrings_of_rows_without_id(spark):
    rng = random.Random(10)
    own = [prose(rng, 40) for _ in range(30)]
    shared = prose(rng, 12)
    texts = [f"{t} {shared}" for t in own]
    rows = spark.createDataFrame([(None, t) for t in texts] + [(2**63 - 1, own[0]), (-5, shared)], "doc_id long, text string")
    got = substrings.repeated(rows).collect()
    lost = [r for r in got if r.doc_id is None]
    assert len(lost) == 30 and sum(r.n_bytes for r in lost) == sum(map(len, texts))
    assert all(len(shared) <= r.n_removed <= len(shared) + 8 for r in lost)  # of (-5), not of one another
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {2**63 - 1: 0, -5: 0}


# ---- every stage, odd tables -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("data"))
    clean = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    items = [prose(rng, 30) for _ in range(3)]
    texts = [
        *clean, None, "", "too short", "line " * 100,
        clean[0], clean[1] + " one more word at the end", " ".join(f"{w}##" for w in clean[2].split()),
        f"{prose(rng, 80)} {items[0]}", f"{prose(rng, 80)} mail a.b@mail.org and +1 277 555 6687 {prose(rng, 20)}", prose(rng, 30000),
    ]
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), "extra", i) for i, t in enumerate(texts)] + [(None, prose(rng, 90), None, None, None, "extra", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fence_symbols string, first long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, items


def test_pipeline_equals_brute_force(spark, sf_dir, monkeypatch):
    at, texts, items = sf_dir
    paths: list[str] = []
    monkeypatch.setattr(corpus_pipeline, "discard", lambda _, path: paths.append(path))
    packed = corpus_pipeline.run(spark, at).collect()
    monkeypatch.undo()
    kept = {}
    for path, (name, _) in zip(paths, corpus_pipeline.STAGES):
        rows = spark.read.parquet(path)
        assert rows.columns == spark.read.parquet(f"{at}/documents.parquet").columns
        kept[name] = rows.collect()
        discard(spark, path)
    assert len(paths) == 4 and len(corpus_pipeline.STAGES) == 5
    by = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert by["quality_rules"] == {*range(40), 44, 45, 47, 48, 49, None}
    assert by["near_duplicates"] == by["quality_rules"] - {44, 45}
    left = {r.doc_id: r.text for r in kept["near_duplicates"]}
    leaks = {i for i, t in left.items() for u in items if SequenceMatcher(None, t.split(), u.split(), autojunk=False).find_longest_match().size >= 18}
    assert leaks == {47} and by["benchmark_leaks"] == by["near_duplicates"] - leaks
    assert by["redaction"] == by["benchmark_leaks"]
    text = {r.doc_id: (r.text, r.n_chars) for r in kept["redaction"]}
    assert "[EMAIL]" in text[48][0] and "[PHONE]" in text[48][0] and text[48][1] == len(text[48][0])
    assert all(text[i][0] == left[i] for i in text if i != 48)
    assert {r.doc_id: r.n_tokens for r in packed} == {i: len(t.split()) for i, (t, _) in text.items()}
    assert len(packed) == len(text) and all(r.n_tokens <= r.padded_to for r in packed)


def test_sieve_lets_no_member_fall(spark):
    rng = random.Random(13)
    members = [rng.randrange(-(2**63), 2**63) for _ in range(500)]
    others = [rng.randrange(-(2**63), 2**63) for _ in range(20000)]
    may = bitmaps.sieve(spark.createDataFrame([(h,) for h in members], "h long"))
    rows = spark.createDataFrame([(h, 1) for h in members] + [(h, 0) for h in others], "h long, member int")
    got = {r.member: r.n for r in rows.filter(may("h")).groupBy("member").count().withColumnRenamed("count", "n").collect()}
    assert got[1] == 500 and got.get(0, 0) < 200
    none = bitmaps.sieve(rows.select("h").limit(0))
    assert rows.filter(none("h")).count() == 0


def test_every_stage_with_clashing_names_and_empty(spark, sf_dir):
    at, *_ = sf_dir
    rng = random.Random(12)
    same = prose(rng, 80)
    rows = [(i, prose(rng, 80), "en", "s") for i in range(6)] + [(7, same, None, "s"), (8, same, "en", None), (8, same, "en", None), (None, None, None, None), (None, same, None, None)]
    for table in (clashing(spark, rows), clashing(spark, rows).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, at)
            got = out.collect()
            if name != "length_packing":
                assert out.columns == table.columns
            if table.isEmpty():
                assert got == []
            elif name in ("benchmark_leaks", "redaction", "length_packing"):
                assert len(got) == len(rows)
            if got and name != "length_packing":
                assert all(r[c] == c for r in got for c in CLASHES)
        assert jaccard.classes(table).columns == [c for c in table.columns if c not in ("class_id", "n_links", "n_copies")] + ["class_id", "n_links", "n_copies"]
        assert quality.with_verdict(table).count() == packing.packed(table).count() == table.count()
        assert substrings.repeated(table).count() == table.count()
