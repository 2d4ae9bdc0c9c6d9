import random

from pyspark.sql import functions as F

import corpus_pipeline
from llm_tables import table  # noqa: F401
from furlong.llm import decontamination, htmltext

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div id="cookie-notice">We use cookies, all of them, always.</div>
<div class="sidebar"><p>Some other story, with commas, and words that go on for quite a while here.</p></div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph,<br>with a break, and an <a href=y>inline link</a>.<p>Second, unclosed &lt;p&gt;
<div class="advert">Buy, buy, buy this thing now.</div><blockquote><p>Quoted, words.</p></blockquote><form>send</form></article>
<section id="comments"><p>Nice, really, a comment, with many, many, commas, indeed.</p></section><footer>&copy; end</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title & more First paragraph, with a break, and an inline link. Second, unclosed <p> Quoted, words."
    for page in (None, "", "<html></html>", "<p", "<!-- open", "</div></p>", "<script>x"):
        assert htmltext.main_text(page) == ""
    assert htmltext.main_text("plain words, no tags") == "plain words, no tags"
    cut = PAGE[: PAGE.index("Second") + 6]
    assert htmltext.main_text(cut).endswith("inline link. Second")


def test_sections_of_one_article_and_siblings_are_kept():
    body = "".join(f"<section><h2>S{i}</h2><p>Part {i}, with a sentence, long enough to count as text of its own.</p></section>" for i in range(4))
    out = htmltext.main_text(f"<div class=menu><a href=a>a, b, c, d, e, f, g, h</a></div><main>{body}</main><div><p><a href=z>links, only, here, and, there</a></p></div>")
    assert [f"S{i}" in out for i in range(4)] == [True] * 4 and "links" not in out and "a, b" not in out
    deep = "<div>" * 3000 + "<p>Deep text, still found, with commas.</p>"
    assert htmltext.main_text(deep) == "Deep text, still found, with commas."


def test_marked_wrappers_of_the_article_are_kept():
    text = "The article itself, with commas, and long enough to be one of its own."
    body, side = f"<h1>Head</h1><p>{text}</p><p>{text}</p>", "<div class=sidebar><p>Another story, with commas, told beside it.</p></div>"
    want = f"Head {text} {text}"
    for name in ("layout has-sidebar", "no-sidebar", "with-banner", "main-content share-enabled"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            assert htmltext.main_text(f"<body><div class='{name}'>{side}{inner}</div></body>") == want
            assert htmltext.main_text(f"<body><form id=f><div class='{name}'>{inner}{side}<nav>go</nav></div></form></body>") == want
    comments = "".join(f"<article><p>Comment {i}, at length, with many words, and commas.</p></article>" for i in range(50))
    assert htmltext.main_text(f"<main>{body}</main><section id=comments>{comments}</section>") == want
    assert htmltext.main_text(f"<article>{body}<form>{text * 9}</form></article>") == want
    assert htmltext.main_text(f"<div hidden>{body}</div>") == ""


def test_extraction_of_rows(table):
    df = table([(1, PAGE, "old"), (2, None, None), (2, "", None)], "page_id long, html string, text string")
    out = htmltext.extract(df).orderBy("page_id").toPandas()
    assert out.text.tolist()[1:] == ["", ""] and out.text[0].startswith("Title & more")


ITEMS = [(7, "If Anna Smith buys 3 apples for 5 dollars, how many dollars does Anna Smith pay for 12 apples?"), (8, "What is the sum of 7"), (9, None), (10, ""), (11, "What is the sum of 7"), (12, "1 2 3 4 5 6 7 8 9 10")]
DOCS = "doc_id long, text string, item string"


def test_leaks(table):
    bob = "if Bob buys 4 apples for 9 dollars, how many dollars does {} pay for 7 apples? ok"
    rows = [
        (1, "Intro here. " + ITEMS[0][1] + " And more.", None), (2, bob.format("Bob"), None), (3, bob.format("Tom"), "other slot value"), (4, None, None), (5, "", None),
        (None, "today: what is the SUM of three", None), (None, "clean words only here", None), (6, "4 5 6 7 8 9 10 11 12 13 14", None), (1, "same key, clean text", None),
    ]
    docs, items = table(rows, DOCS), table(ITEMS, "item_id long, text string")
    out = {(r.doc_id, r.item, r.kind) for r in decontamination.leaks(docs, items).collect()}
    assert out == {(1, 7, "exact"), (2, 7, "reparameterised"), (None, 8, "reparameterised")}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.text for r in kept.collect()))) == sorted(map(repr, (rows[i][1] for i in (2, 3, 4, 6, 7, 8))))
    assert decontamination.leaks(docs.limit(0), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0 and decontamination.clean(docs, items.limit(0)).count() == len(rows)


def test_copies_of_placeholder_heavy_and_short_items(table):
    texts = ["What is 12 + 35 + 47 + 88 + 93?", "1 2 3 5 8 13 21 34 55 89 144 233", "The Old Man And The Sea Again", "Add 3 4", "If 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 are summed up, what comes out of it?"]
    items = table([*enumerate(texts), (5, "?!"), (6, texts[0])], "item_id long, text string")
    rows = [(i, f"some words before. {t.lower()} and after", None) for i, t in enumerate(texts)]
    rows += [(7, "What is 12 + 35 + 47 + 88 + 94?", None), (8, "2 3 5 8 9 13 21 34 55 90", None), (9, "?!", None), (None, texts[4], None)]
    out = {(r.doc_id, r.item, r.kind) for r in decontamination.leaks(table(rows, DOCS), items).collect()}
    assert out == {*((i, i, "exact") for i in range(5)), (None, 4, "exact")}


def test_names_at_the_start_of_sentences(table):
    tom = "{0} has {1} apples. {0} buys {2} more. How many apples does {0} have?"
    ride = "{0} rides to the {1} shops by noon. Then the old mule of the neighbour rests for {2} hours there."
    items = table([(1, tom.format("Tom", 5, 3)), (2, ride.format("Tom", 5, 3)), (3, tom.format("Ann Lee", 5, 3).replace("apples", "pears"))], "item_id long, text string")
    texts = [tom.format("Anna", 7, 2), tom.format("Tom", 5, 3).lower(), ride.format("Eve", 4, 9), tom.format("Bob", 1, 2).replace("apples", "pears"), tom.format("Anna", 7, 2).replace("does Anna", "does Eve").replace("Anna buys", "Bob buys")]
    out = {(r.doc_id, r.item, r.kind) for r in decontamination.leaks(table([(i, f"Intro. {t} Outro.", None) for i, t in enumerate(texts)], DOCS), items).collect()}
    assert out == {(0, 1, "reparameterised"), (1, 1, "exact"), (2, 2, "reparameterised"), (3, 3, "reparameterised")}


def test_leaks_against_plain_search(spark, table):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(draw.randint(9, 40))) + ".") for i in range(30)]
    rows = [(i, " ".join([*(word() for _ in range(30)), ".\n", *([items[i % 30][1]] if i % 3 == 0 else []), *(word() for _ in range(30))]), None) for i in range(90)]
    got = {(r.doc_id, r.item) for r in decontamination.leaks(table(rows, DOCS), table(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t, _ in rows for i, x in items if x in t}


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [text(80) for _ in range(20)]
    item, passage = text(30), text(60)
    near = clean[0].split()
    near[40] = "changed"
    texts = [*clean, clean[1], " ".join(near), f"{text(40)}\n{item}\n{text(40)}", f"{text(50)} {passage}", f"{passage} {text(50)}", None, "", "123 !!"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, more int"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").distinct().collect()))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0] == [*range(25)] and kept[1] == [*range(20), 22, 23, 24] and kept[2] == kept[1] and kept[3] == [*range(20), 23, 24] == kept[4]
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert left[5] == clean[5] and passage not in left[23] and passage not in left[24] and len(left[23]) < len(texts[23])
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert packed.n.max() <= 4096 and len(packed) == -(-packed.n.sum() // 4096)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
