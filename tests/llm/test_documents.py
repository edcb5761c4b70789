"""Archives, chats, quality rules, web pages and the pipeline."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutua.llm import chat, gbt, html_extract, quality, warc
from mutua.storage import scratch


def test_archives_round_trip(spark):
    big = "é<p>" * 200_000
    rows = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, None), (4, "http://a/4", ""), (5, "u\r\n5", "y" * 99), (6, "u", "y" * 99), (7, "u", big), (0, "u", "é" * 50), (9, "u", "é" * 50), (2, "http://a/2", "x" * 200), (None, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    folder = scratch(spark, "warc-test")
    files = warc.write_archives(pages, folder, file_bytes=2000)
    got = warc.read_archives(files, folder).collect()
    assert len(got) == len(rows) == sum(r.n for r in files.collect())
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        same = [i for i, _, h in rows if i is not None and (h or "") == html]
        revisit = r.page_id is not None and len(data) >= 100 and r.page_id > min(same)
        assert (r.record_type, r.refers_to) == (("revisit", min(same)) if revisit else ("response", None)), r.page_id
        assert bytes(r.payload) == (b"" if revisit else data)


def test_archive_of_no_pages(spark):
    folder = scratch(spark, "warc-test")
    files = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(files, folder).count() == 0


def test_reader_checks_what_it_reads():
    payload = b"hello\r\n\r\nthere" * 100
    good = warc.encode({"WARC-Type": "response", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest()}, payload)
    assert [r.payload for r in warc.read_records(io.BytesIO(good * 3).read)] == [payload] * 3
    tiny = io.BytesIO(good * 2)
    assert [r.payload for r in warc.read_records(lambda n: tiny.read(7))] == [payload] * 2
    bad = warc.encode({"WARC-Type": "response", "WARC-Payload-Digest": "sha256:0"}, payload)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad).read))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20]).read))
    short = zlib.compressobj(wbits=31)
    data = short.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + short.flush()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data).read))


def test_chats_read_back(spark):
    rng = random.Random(2)
    bits = ["</s>", "<|turn|>", "<|and|>", "&", "&l", "&amp;", "[INST]", "é", "\n", "ok", "<", "[", "<|end|>"]
    rows = [(c, k, rng.choice(["user", "assistant", "assistant", "system", "a<b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), 0) for c in range(60) for k in range(rng.randint(1, 9))]
    rows += [(100, 1, "user", None, 0), (100, None, "assistant", "first", 0), (100, 1, "user", None, 0), (None, 1, None, "x", 0), (101, 2, "assistant", "b", 0), (101, 2, "assistant", "a", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    out = chat.format_chats(turns).withColumn("read", chat.parse_chats(F.col("formatted"))).withColumn("spans", chat.loss_spans(F.col("segments"))).collect()
    assert len(out) == len({r[0] for r in rows})
    for r in out:
        own = sorted((x[1] is not None, x[1] or 0, x[2] or "user", x[3] or "") for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.read] == [(role, text) for _, _, role, text in own]
        assert all(a.role != b.role for a, b in zip(r.messages, r.messages[1:]))
        learnt = "".join(r.formatted[s.start : s.end] for s in r.spans)
        for plain, escaped in reversed(chat.CHAT.guarded):
            learnt = learnt.replace(escaped, plain)
        assert learnt == "".join(text for _, _, role, text in own if role == "assistant")
    assert chat.format_chats(turns.limit(0)).count() == 0


def plain_stats(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}))


def test_base_quality_counts():
    rng = random.Random(3)
    pieces = ["a", "b", "é", "ab", " ", " ", "\n", "\t", "#", "*x", "\x0b", "\x85", "　", "\xa0"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces[: rng.choice([5, 14])]) for _ in range(rng.randint(0, 80)))
        s = quality.describe(text)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == plain_stats(text), repr(text)
    assert quality.describe(None).n_words == 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=800) > 0).astype(float)
    model = gbt.fit(x, y, np.array([1, -1, 0]), trees=30)
    assert ((model.score(x) > 0) == y).mean() > 0.9
    for column, sign in ((0, 1), (1, -1)):
        for row in x[:40]:
            line = np.repeat(row[None], 50, 0)
            line[:, column] = np.linspace(-3, 3, 50)
            assert (sign * np.diff(model.score(line)) >= -1e-12).all()
    assert gbt.fit(x[:0], y[:0], np.zeros(3, int)).score(x).shape == (800,)


def test_flat_trees_score_as_recursion_does():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 1)
    model = gbt.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), np.zeros(4, int), trees=12, depth=3)

    def walk(k, row):
        if model.left[k] == k:
            return model.value[k]
        return walk(model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k], row)

    want = [model.bias + sum(walk(r, row) for r in model.roots) for row in x]
    assert np.allclose(model.score(x), want) and len(model.feature) > 40


def test_quality_model_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.where(~test))
    got = quality.judge(docs, model).join(labels.where(test), "doc_id").toPandas()
    free = got[~got.base_failed]
    assert free[free.toxic == 1].kept.mean() < 0.05
    assert free[(free.quality == 1) & (free.toxic == 0)].kept.mean() > 0.97


def test_quality_rules_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "word " * 40, 5), (2, "one two three four five six seven eight nine ten eleven", 5)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, model).collect()}
    assert got == {1: (True, False), None: (True, False), 2: (False, True)}
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs, model).count() == 1
    assert quality.judge(docs.limit(0), model).count() == 0


ARTICLE = ["The title", "First paragraph, with some commas, and enough words to be one.", "Second & last paragraph of the text, long enough to be counted as one."]
P = "<h1>The  title</h1><p>First paragraph, with <b>some</b> commas,\n and enough words to be one.</p><p>Second &amp; last paragraph of the text,<br>long enough to be counted as one.</p>"
NOISE = "<nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>"
PAGES = [
    f"<html><head><title>t</title><script>var a='<p>no, no, no</p>';</script></head><body>{NOISE}<article>{P}</article><footer>c 2020, all rights, reserved, by us and them</footer></body></html>",
    f"<body><header><h2>Site, name, and a long slogan here</h2></header><div id=main><div class=content>{P}</div><div class='sidebar'><p>Other, things, to read, that are not part, of the article at all.</p></div></div></body>",
    f"<body>{NOISE}<div class='post'>{P}</div><section class='comments'><p>I, for one, think, that this is, a very long comment, of a reader.</p></section><form><p>Subscribe, now, to, our, letter, and get it each week.</p></form></body>",
    f"<main><div class=\"cookie-notice\"><p>We use cookies, as everybody does, and you accept, all of them, now.</p></div>{P.replace('</p>', '')}</main><aside><p>Some, more, text, that is not, of the article.</p></aside>",
    f"<!-- <p>old</p> --><article><div style='display:none'><p>hidden, text, that nobody, sees, at all, on the page.</p></div><header>{P[:P.index('<p>')]}</header>{P[P.index('<p>'):]}</article>",
]


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_extract.main_text(page).split("\n\n") == ARTICLE


LONG = "A sentence of the article, with commas, that is long enough to be a paragraph of its own."


def test_article_text_is_not_cut():
    text = lambda inner: html_extract.main_text(f"<body>{NOISE}<article><h1>T</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>")
    for inner, want in [
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<h2 id="search">Search</h2>', "Search"),
        ('<pre>x <span class="hljs-comment"># why</span></pre>', "x # why"),
        ('<div class="legal">By law it is so.</div>', "By law it is so."),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>", "so x=1"),
        ("<object><p>In an object, it is.</p></object>", "In an object, it is."),
        ("<noscript><p>Shown without scripts.</p></noscript>", "Shown without scripts."),
        ("<aside>Pulled out of the text.</aside>", "Pulled out of the text."),
        ("<p><a title=it's href=x>its link</a> goes on</p><p>isn't it</p>", "its link goes on\n\nisn't it"),
        ("<p>AT&<b>reg</b> and AT&amp;T &lt;b&gt;</p>", "AT&reg and AT&T <b>"),
        ("<p class=hidden-gem>A gem.</p>", "A gem."),
    ]:
        assert text(inner) == f"T\n\n{LONG}\n\n{want}\n\n{LONG}", inner
    for inner in ('<div class="share">Share this</div>', "<form><p>Your mail</p></form>", "<p hidden>no</p>", '<section id="comments"><p>Me, too, I say, and so on and so on.</p></section>', '<div class="ad">Buy, buy, buy this and that and more.</div>'):
        assert text(inner) == f"T\n\n{LONG}\n\n{LONG}", inner


def test_sibling_containers_are_kept():
    big, small = f"<p>{LONG}</p>" * 4, f"<p>Short one. {LONG}</p>"
    want = "\n\n".join([LONG] * 4 + [f"Short one. {LONG}"])
    side = f"<div class='sidebar'><p>{LONG}</p></div>"
    assert html_extract.main_text(f"<body>{NOISE}<div><div>{big}</div><div>{small}</div></div>{side}</body>") == want
    assert html_extract.main_text(f"<body>{NOISE}<div><div><div>{big}</div></div><div><div>{small}</div></div></div>{side}</body>") == want


def test_pages_without_articles(spark):
    for page in (None, "", "<", "<p", "<script>x", "&amp", "<nav><a href=x>y</a></nav>", "</p></div>", "<!--"):
        html_extract.main_text(page)
    assert html_extract.main_text(None) == "" and html_extract.main_text("<nav><a>x</a></nav>") == ""
    pages = spark.createDataFrame([(1, "u", PAGES[0], "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {1: "\n\n".join(ARTICLE), 2: ""}
    assert html_extract.extract(pages.limit(0)).count() == 0
    html_extract.main_text("<div>" * 20_000 + "text, deep, down, and long enough to count" + "</div>" * 20_000)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, None, "", "", 0), (1, None, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf_dir).count()
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert got.doc_id.nunique() > 0 and (got.bin_used.dropna() <= got.bin_capacity.dropna()).all()


@pytest.mark.parametrize("names", ["row_hash kept_id kept_hash node grp n key src", "bad_id bad_digest digest own_id own_digest id hits n_words", "row spans text_col changed masked kept own_hash component"])
def test_clashing_columns_pass_every_stage(spark, sf_dir, names):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.withColumns({c: F.lit(c) for c in names.split()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.count() > 0, name
        assert {tuple(r) for r in kept.select(*names.split()).collect()} == {tuple(names.split())}, name


def test_what_stages_keep(spark, sf_dir):
    """Every stage against its operator's rule written again: which rows stay, and that they stay as they are."""
    import duckdb

    import corpus_pipeline
    from mutua.llm import decontaminate, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {name: {r.doc_id: r for r in stage(spark, docs, sf_dir).collect()} for name, stage in corpus_pipeline.STAGES[:-1]}
    failed = {k for k, r in rows.items() if (s := quality.describe(r.text)) and quality.base_failed(s.n_words, s.n_repeat_words)}
    assert failed and not failed & set(kept["quality rules"])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = {k for k, c in con.execute(f"SELECT doc_id, contaminated FROM ({decontaminate.ORACLE_SQL})").fetchall() if c}
    assert set(kept["decontamination"]) == set(rows) - bad
    for name in ("quality rules", "near duplicates", "decontamination"):
        assert all(r == rows[k] for k, r in kept[name].items()), name
    assert set(kept["secret scan"]) == set(rows)
    changed = [k for k, r in kept["secret scan"].items() if r.text != rows[k].text]
    assert all("[SECRET]" in kept["secret scan"][k].text and kept["secret scan"][k].n_chars == len(kept["secret scan"][k].text) for k in changed)
    # Near duplicates: pairs found by brute force over five-word shingles lose a row, all others stay.
    shingles = {}
    for k, r in rows.items():
        w = (r.text or "").encode().lower().split()
        shingles[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(k for k in rows if shingles[k])
    linked = {k: {k} for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                joined = linked[a] | linked[b]
                for c in joined:
                    linked[c] = joined
    want = {min(g) for g in linked.values()} | {k for k in rows if not shingles[k]}
    got = set(kept["near duplicates"])
    wordless = {k for k in rows if not shingles[k]}
    assert want - got <= wordless and len(got - want) <= 0.02 * len(want)
