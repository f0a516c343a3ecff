"""Operators on texts, against brute force on small tables that hold the odd cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tempestry.llm import boosting, decontamination, jaccard, packing, privacy, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en" if k % 3 else None, "s" if k % 2 else None, len(t or ""), "x") for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(1, 120), 4000) for _ in range(40)]
    near = [b.replace(" ", "  ", 1) for b in base[:5]] + [f"{b} tail end" for b in base[5:15]]
    long = sentence(rng, 20000, 5000)
    return [None, "", "   \n", "é" * 60, "a" * 300, *base, *base[:6], *near, long, f"{long} more", "same words here now again " * 40, "\n".join(["line"] * 30)]


def test_quality_counts(spark, texts):
    got = {r.doc_id: r for r in quality.with_verdict(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(repeated), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_far_values(spark):
    rng = random.Random(1)
    clean = [sentence(rng, 120, 5000) for _ in range(120)]
    rows = docs(spark, [*clean, " ".join(f"{w}###" for w in clean[0].split())])
    kept = {r.doc_id for r in quality.with_verdict(rows).filter("kept").collect()}
    assert kept == set(range(120))


def brute_substrings(texts, n=50):
    first, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first.setdefault(b[k : k + n], i) < i:
                cover[k : k + n] = b"\1" * n
        kept = bytes(c for c, m in zip(b, cover) if not m)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, texts):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefg ") for _ in range(70))
    more = [f"{sentence(rng, 30)}{passage[k % 9 :]}{sentence(rng, 10)}" for k in range(25)]
    periodic = ["ab" * 80, "xx" + "ab" * 60 + "yy", "abc" * 50, "zabc" + "abc" * 30]
    rows = [*texts, *more, *periodic]
    for slice_bytes in (2 << 20, 3000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated(docs(spark, rows), substrings.SubstringParams(slice_bytes=slice_bytes)).collect()}
        assert got == brute_substrings(rows)


def test_substrings_repeated_and_null_ids(spark):
    text = "the very same text, long enough to be removed where it comes again"
    got = substrings.repeated(docs(spark, [text, text, text, text], [3, 3, 5, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 5, len(text)), (True, 0, len(text))]


def brute_classes(texts, t=0.8):
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None)
    links, parent = collections.Counter(), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard(spark, texts, block):
    rng = random.Random(9)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    group = []
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(150)] = f"u{rng.randrange(3000)}"
        group.append(" ".join(w))
    rows = [*texts, *group]
    p = jaccard.JaccardParams(block=block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs(spark, rows), p).collect()}
    assert got == brute_classes(rows)
    kept = {r.doc_id for r in jaccard.deduplicated(docs(spark, rows), p).collect()}
    assert kept == {c for c, _ in brute_classes(rows).values()}


def test_bayes_bound():
    least = jaccard.least_matches(jaccard.JaccardParams())
    assert least == sorted(least) and 0 < least[0] < 16 and least[-1] < 64


def test_tiles_are_greedy_and_disjoint():
    doc = list("abcdefgXhijklmn")
    item = list("hijklmnabcdefg")
    at = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if doc[i : i + 3] == item[j : j + 3]]
    found = decontamination.tiles(np.array([a for a, _ in at]), np.array([b for _, b in at]), 3)
    assert sorted(found) == [(0, 7, 7), (8, 0, 7)]


def test_decontamination(spark):
    rng = random.Random(2)
    items = [sentence(rng, 30, 900) for _ in range(6)]
    words = items[0].split()
    rows = [sentence(rng, 200, 900) for _ in range(30)]
    rows[3] += " " + items[1].upper().replace(" ", ", ")
    rows[4] = f"{' '.join(words[15:])} {rows[4]} {' '.join(words[:15])}"  # reordered halves
    rows[5] += " " + " ".join(items[2].split()[:10])  # a third of an item
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, "too short"), (1, items[1])], "item_id long, text string")
    found = decontamination.contaminated(docs(spark, [*rows, None, ""]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(3, 1), (4, 0)}
    assert decontamination.clean(docs(spark, rows), bench).count() == 28


def test_base_spans_follow_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@-+ 2(") for _ in range(30))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in card.finditer(t):
            d = re.sub(r"\D", "", m.group())
            if 13 <= len(d) <= 19 and privacy.luhn(d):
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
        assert privacy.base_spans(t) == want, t


def test_privacy(spark):
    rows = [None, "", "mail a.b@mail.org, call +1 (277) 555-6687 or (277) 555-6688 soon", "write joe [at] mail [dot] com please", "version 10.2.3 of 2024-01-02 12", "4111 1111 1111 1111 and 10.0.0.1 é 9", "x" * 200000 + "@"]
    table = docs(spark, rows)
    model = privacy.fit(table)
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in privacy.with_spans(table, model).collect()}
    assert got[0] == got[1] == got[4] == got[6] == []
    assert got[2] == [("email", True), ("phone", True), ("phone", False)]
    assert got[3] == [("email", False)]
    assert got[5] == [("ip", True), ("card", True)]
    text = {r.doc_id: r.text for r in privacy.redacted(table, model).collect()}
    assert text[2] == "mail [EMAIL], call [PHONE] or [PHONE] soon" and text[0] is None and text[4] == rows[4]


def test_boosting_learns():
    rng = np.random.RandomState(0)
    x = rng.rand(800, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    model = boosting.fit(x, y)
    assert ((boosting.predict(model, x) > 0.5) == y).mean() > 0.97
    assert boosting.calibrated_threshold(np.array([0.9, 0.8, 0.3]), np.array([1, 1, 0]), 0.99) == pytest.approx(0.55)


def test_packing_optimum():
    rng = random.Random(8)
    lengths = sorted({rng.randrange(1, 60) for _ in range(12)})
    hist = [(n, c, n * c) for n in lengths for c in [rng.randrange(1, 9)]]

    def cost(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c, _ in hist)

    import itertools

    best = min(cost((*b, lengths[-1])) for b in itertools.combinations(lengths[:-1], 3))
    bounds, total = packing.optimal_bounds(hist, 4)
    assert total == best == cost(bounds) and packing.optimal_bounds([], 4) == ([], 0)


def test_packing_places(spark, texts):
    p = packing.PackingParams(buckets=4, token_budget=400, shard_docs=8)
    rows = packing.packed(docs(spark, texts), p).collect()
    assert len(rows) == len(texts)
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_to
        batches[r.bucket, r.shard, r.batch].append(r)
    for members in batches.values():
        assert len(members) == 1 or len(members) * members[0].padded_to <= 400
        assert sorted(m.place for m in members) == list(range(1, len(members) + 1))


def test_toxicity_reads_every_form_and_length(spark):
    plain = ["the people in the town walk to the river", "some idiot and a moron stand on grass near the class", "you are a worthless idiot you said"] * 40
    model = toxicity.language_model(docs(spark, plain))
    forms = ["idi07", "1d1o7", "i.diot", "id-iot", "iiddiioott", "i" + "d" * 70 + "iot", "!d!ot", "idiot!", "idiot" + "." * 80 + "idiot"]
    words = {w: toxicity.readings(w, model, {}) for w in forms}
    assert all("idiot" in " ".join(found) for found in words.values()), words
    assert [toxicity.restore(w, model) for w in ("gra55", "gra$$")] == ["grass", "grass"]
    spelled = " ".join("youareaworthlessidiot" * 4)  # far beyond 33 letters
    assert toxicity.restore(spelled, model).replace(" ", "") == "youareaworthlessidiot" * 4
    p = toxicity.ToxicityParams()
    _, bucket = toxicity.word_features(pa.array(["idiot"], pa.large_string()), p)
    for text in [*forms, f"a text of {spelled}"]:
        assert bucket[0] in np.frombuffer(toxicity._features(pa.array([text], pa.large_string()), model, p, {})[0], "<i4"), text
    assert toxicity.restore("ab" * 100000, model) == "ab" * 100000  # linear in length


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        t = sentence(rng, 40, 300)
        toxic = i % 5 == 0
        word = rng.choice(["idiot", "loser", "moron"])
        word = {0: word, 1: word.replace("o", "0"), 2: " ".join(word), 3: word[0] + word[1] * 4 + word[2:]}[i % 4] if toxic and i > 200 else word
        rows.append(f"{t} {word} {t}" if toxic else t)
        labels.append((i, int(toxic) if i < 200 else None))
    rows += [None, ""]
    table = docs(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in toxicity.toxicity(table, known, F.col("doc_id") < 200).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    wrong = [i for i in range(300) if got[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 6, wrong
    assert got[300].predicted == got[301].predicted == 0


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.with_verdict(none).count() == 0
    assert substrings.repeated(none).count() == 0
    assert jaccard.classes(none).count() == jaccard.deduplicated(none).count() == 0
    assert decontamination.contaminated(none, bench).count() == 0
    assert privacy.with_spans(none, privacy.fit(none)).count() == 0
    assert packing.packed(none).count() == 0
    from pyspark.sql import functions as F

    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).count() == 0
