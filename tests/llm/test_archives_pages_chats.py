"""Archives, page extraction and chats."""

import hashlib
import random
import uuid

from tempestry.llm import archives, chats, extraction
from tempestry.llm.common import shared_dir


def pages(spark, htmls, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], f"http://x/{k}", h, "extra") for k, h in enumerate(htmls)], "page_id long, url string, html string, record_type string")


def test_round_trip_with_magic_in_payloads(spark):
    inner = archives.VERSION + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "payload " * 50
    htmls = [None, "", "tiny", "tiny", big, big, inner, big + inner + inner + "tail", archives.VERSION * 5 + big, f"é{archives.END}{archives.VERSION}Content-Length: 9999\r\n\r\n", *[f"{big}{k}" for k in range(20)]]
    for compression in ("gzip", "none"):
        path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        archives.write(pages(spark, htmls).repartition(3), path, compression=compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = {r.page_id: r for r in archives.read(spark, path).collect()}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert set(got) == set(range(len(htmls)))
        for k, h in enumerate(htmls):
            data = (h or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest()), (k, got[k])
            assert (got[k].record_type, got[k].refers_to) == (("revisit", 4) if k == 5 else ("response", None))


def test_repeated_and_null_ids(spark):
    big = "z" * 200
    got = archives.round_trip(pages(spark, [big, big, big, "a"], [7, 7, 9, None])).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.refers_to or 0) for r in got) == [(False, 7, 0), (False, 7, 0), (False, 9, 7), (True, 0, 0)]
    assert archives.round_trip(pages(spark, [])).count() == 0


def test_parse_and_decode():
    nodes, blocks = extraction.parse("<html><body><nav><a href=x>m</a></nav><div><p>one<p>two <b>bold</b>&amp;<br>x</p></div><script>if(a<b){}</script><!-- <p>no</p> --></body>")
    assert [t for _, t, _ in blocks] == ["m", "one", "two bold& x"]
    extraction.node_features(nodes, blocks)
    import numpy as np

    kept = extraction.decode(nodes, np.array([0.9, 0.1, 0.2, *[0.95] * (len(nodes) - 3)]))
    for n in nodes[1:]:
        assert not kept[n.number] or kept[n.parent.number]


def test_extraction(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "field", "house"]) for _ in range(n)) + "."
    htmls, want = [], []
    for k in range(60):
        ps = [say(rng.randrange(6, 60)) for _ in range(rng.randrange(2, 6))]
        title = say(5)
        side = f'<div class="sidebar"><ul><li><a href=a>{say(2)}</a></li><li><a href=b>{say(2)}</a></li></ul></div>'
        comment = f'<div class="comments"><h3>Comments</h3><div class="comment"><p>{say(12)}</p></div></div>'
        htmls.append(f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>{say(1)}</a></li></ul></nav><div class=ad>{say(6)}</div><article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</article>{side if k % 2 else ''}{comment if k % 3 == 0 else ''}<footer>&copy; {say(6)}</footer></body></html>")
        want.append("\n".join([title, *ps]))
    table = pages(spark, [*htmls, None, "", "<p", "plain"])
    got = {r.page_id: r.text for r in extraction.extracted(table, extraction.fit(table)).collect()}
    assert sum(got[k] == want[k] for k in range(60)) >= 57
    assert got[60] == got[61] == ""
    assert extraction.extracted(pages(spark, []), extraction.fit(pages(spark, []))).count() == 0


def test_chats(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (3, 2, "u", "ok"), (3, 2, "u", "ok"), (4, 5, "u", "hi"), (4, 6, "a", "yo"), (4, 7, "u", "ok"), (5, 0, None, None), (None, 0, "u", "hi"), (6, 0, "u", "other")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chats.rendered(table).collect()}
    assert got == {3: (3, 2, "<|u|>\nhi\n<|a|>\nyo\n<|u|>\nok\n"), 5: (1, 1, "<||>\n\n"), 6: (1, 1, "<|u|>\nother\n")}
    assert chats.rendered(table.limit(0)).count() == 0


def test_siblings_of_one_tag_at_every_width():
    for width in (150, 250):
        nodes, blocks = extraction.parse("<div>" + "<p>some words.</p>" * width + "<section>advert</section></div>")
        row = extraction.node_features(nodes, blocks)[-1]
        assert nodes[-1].tag == "section"
        assert row[-6:-2] == [width + 1, 1, 6 / nodes[1].size, False]


def test_parse_keeps_text_under_the_root_and_after_unclosed_elements():
    forms = {
        "plain": ["plain"],
        "<body>one<br>two <b>x</b><p>p</p>tail</body>": ["one two x", "p", "tail"],
        "<div><button>go<p>text</p><button>ok</button></div><p>rest": ["text", "rest"],
        "<p>a</p><svg><path><p>b</p>": ["a", "b"],
        "<p>a</p><object><p>b</p><p>c": ["a", "b", "c"],
        "<select><option>a<p>text": ["text"],
        "<head><title>t</title><meta x><p>article": ["article"],
        "<head><title>t</title>words": ["words"],
        "<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be": ["let x=1 be"],
        "<svg><svg>q</svg>r</svg>z": ["z"],
        "<head><style>a{}</style><script>'<p>'</script></head><body>yes<script>x": ["yes"],
    }
    for page, want in forms.items():
        nodes, blocks = extraction.parse(page)
        assert [t for _, t, _ in blocks] == want, page
        assert all(n.parent for n, _, _ in blocks)


def test_bare_articles_are_extracted(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "field", "house"]) for _ in range(n)) + "."
    text = lambda n: " ".join(say(8) for _ in range(n))
    known = [f"<body><nav><ul><li><a href=x>{say(1)}</a></li></ul></nav><div class=ad>{say(6)}</div><article><h1>{say(5)}</h1>{''.join(f'<p>{text(4)}</p>' for _ in range(4))}</article><footer>{say(6)}</footer></body>" for _ in range(60)]
    article = [text(8), text(6)]
    bare = f"{article[0]}<br><b>{article[1]}</b>"
    table = pages(spark, [*known, f"<html><body>{bare}</body></html>", f"<body><nav><ul><li><a href=x>menu</a></li><li><a href=y>more</a></li></ul></nav>{bare}<div class=footer>legal</div></body>"])
    got = {r.page_id: r.text for r in extraction.extracted(table, extraction.fit(table)).collect()}
    assert got[60] == " ".join(article)
    assert got[61] == " ".join(article)


def test_articles_without_telling_names(spark):
    """Pages whose article is a plain element, or none of its own, by a model of pages that name it."""
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "field", "house", "tree"]) for _ in range(n)) + "."

    def page(opened, closed):
        ps = [say(rng.randrange(8, 70)) for _ in range(rng.randrange(2, 7))]
        title, sub = say(4), say(3)
        body = f"<h1>{title}</h1><p>{ps[0]}</p><h2>{sub}</h2>{''.join(f'<p>{t}</p>' for t in ps[1:])}"
        side = f'<div class="sidebar"><h3>{say(2)}</h3><ul>{"".join(f"<li><a href=a>{say(2)}</a></li>" for _ in range(4))}</ul></div>' if rng.random() < 0.6 else ""
        notes = f'<div class="comments"><div class="comment"><p>{say(14)}</p></div></div>' if rng.random() < 0.5 else ""
        html = f'<html><body><nav><ul><li><a href=x>{say(1)}</a></li><li><a href=y>{say(1)}</a></li></ul></nav>{side}<div class="wrap">{opened}{body}{closed}</div>{notes}<footer>&copy; {say(5)}</footer></body></html>'
        return html, "\n".join([title, ps[0], sub, *ps[1:]])

    model = extraction.fit(pages(spark, [page('<article class="post">', "</article>")[0] for _ in range(70)]))
    for opened, closed in (("<div>", "</div>"), ("<section>", "</section>"), ('<div class="x17">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><div>", "</div></div>"), ("<article>", "</article>")):
        some = [page(opened, closed) for _ in range(40)]
        assert sum(a == b for a, b in zip(extraction.main_texts([h for h, _ in some], model), [w for _, w in some])) >= 38, opened
    long = page("<div>", "</div>")[0].replace("<h1>", "<p>" + "word " * 200_000 + "</p><h1>")
    assert len(extraction.main_texts([long], model)[0]) > 900_000
