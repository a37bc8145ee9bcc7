import re
from html import unescape

from snapweave.llm import html_text, licenses

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, labels = [], set(), set()
    for label, is_base, _, key in licenses.TEMPLATES:
        k = key.split()
        hits = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
        if hits:
            labels.add(label)
        if hits and is_base:
            base.add(label)
            starts += hits
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "CC BY", "cc, by! cc by-nc 4.0", "GNU Lesser General Public License, version 3. All rights\nreserved.", "all rights all rights reserved reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "public license general public license version 2", "é cc by é",
    "general public", "word " * 3000 + "All Rights Reserved", "Licensed under the Apache License, Version 2.0", "cc by " * 500,
]


def test_licenses_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "CC BY", "x"), (None, "cc by", None)], "doc_id long, text string, words string")
    got = licenses.scan(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert tuple(r)[1:7] == brute("cc by" if r["doc_id"] is None else TEXTS[r["doc_id"]]) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    by = {r["doc_id"]: r for r in got}
    assert by[7]["score"] == 1.0 and by[7]["labels"] == "mit"
    assert licenses.scan(df.limit(0)).collect() == []


def test_licenses_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert all(tuple(r)[1:7] == brute(texts[r["doc_id"]]) for r in got) and any(r["labels"] for r in got)
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()


PAGES = {
    None: "", "": "", "plain &amp; simple": "plain & simple", "<nav><a href=/>Home</a></nav>": "", "<p>one<p>two": "one\ntwo",
    "<div class='comments'><p>Great, thanks, bye.</p></div><div id=main><h2>T</h2><p>Long text, it is here. More, yes.</p><p>ok</p></div><footer>&copy;</footer>": "T\nLong text, it is here. More, yes.\nok",
    "<body><header>Site</header><main><header><h1>Head</h1></header><p>Some text, with commas,\n and  more.</p><aside>side</aside><form>f<input></form><p>Short</p></main><div class='cookie-notice'>We use cookies, ok?</div>": "Head\nSome text, with commas, and more.\nShort",
    "<article><p>a<br>b</p><script>if (a<b) x('</p>')</script><!-- <p>no</p> --><p>c &lt;d&gt; &#233;</p></article>": "a b\nc <d> é",
    "<article><p>unclosed <b>bold<p>next</article><p>after": "unclosed bold\nnext",
    "<p>x</p>" * 3: "x\nx\nx", "<": "<", "<p title='a>b'>q</p>": "q",
}


def test_main_text():
    for html, want in PAGES.items():
        assert html_text.main_text(html) == want, html


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t"), (2, "u", "<div>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(odd).collect()) == ["", "", "deep", "x"]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_ratios_choose_without_names():
    """Clutter whose names say nothing goes, an article within an element with a misleading name stays."""
    from snapweave.llm.html_text import main_text

    article = "<h1>Title</h1>" + "".join(f"<p>Sentence {i} of the article, with a few more words, and a point. Another one; it goes on.</p>" for i in range(5))
    text = main_text(f"<article>{article}</article>")
    assert text.count("\n") == 5 and text.startswith("Title\n")
    links = "<div class='x1'><ul><li><a href='/'>Home</a></li><li><a href='/s'>Shop now</a></li><li><a href='/i'>Sign in</a></li></ul></div>"
    for html in (
        f"<body><article>{article}{links}</article></body>",
        f"<body>{links}<div class='x7'>{article}</div><div class='x2'>2024 Some Company</div></body>",
        f"<body><div class='menu-planner'>{article}</div></body>",
        f"<body><div class='post has-sidebar'>{article}</div><div class='sidebar'>Other news here</div></body>",
        f"<body><div id='a'>{links}</div><main class='related-work'><section class='header-fixed'>{article}</section></main></body>",
    ):
        assert main_text(html) == text, html


def test_word_list_is_not_needed(sf_dir):
    import pyarrow.parquet as pq

    from snapweave.llm.html_text import main_text

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()
    both = kept = all_ = 0
    for html in pages:
        a, b = set(main_text(html).split("\n")), set(main_text(html, words=False).split("\n"))
        both, kept, all_ = both + len(a & b), kept + len(b), all_ + len(a)
    print("word list off: precision", both / kept, "recall", both / all_)
    assert both >= 0.99 * kept and both >= 0.99 * all_
