"""Cases of ranking, spelling, community, seed, sink and streaming operators."""

import pytest
from pyspark.sql import functions as F

from quern.operators import forum as C
from quern.operators import indexing as I
from quern.operators import ranking as R
from quern.operators import search as S
from quern.sources import seeds as D
from quern.sources import tables as W


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("search", "starch", "engine", "cat", "cats", "a")], "word string")
    terms = spark.createDataFrame([(w,) for w in ("serch", "engin", "cat", "catz", "zzzzz", "", "x")], "term string")
    got = {r["term"]: r["correction"] for r in S.corrected(terms, words).collect()}
    assert got == {"serch": None, "engin": "engine", "cat": "cat", "catz": "cat", "zzzzz": None, "x": None}
    q = S.corrected_query(spark, "Engin+cat  unknownword", words).first()
    assert (q["query"], q["changed"]) == ("engine cat unknownword", True)


def test_page_rank_of_a_small_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (9, 1)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    got = {r["node"]: r["rank"] for r in R.page_rank(e, nodes, 1).collect()}
    assert got[1] == pytest.approx(0.05 + 0.85 / 3) and got[2] == got[3] == pytest.approx(0.05 + 0.85 / 6)


def test_idf_may_be_negative(spark):
    w = spark.createDataFrame([("u", "x"), ("v", "x")], "url string, word string")
    m = spark.createDataFrame([("u",), ("v",)], "url string")
    assert R.idf(w, m).first()["idf"] < 0


def test_scaling(spark):
    q = spark.createDataFrame([(0, 10), (500, 10), (999, 10), (1000, 10), (1000, 5)], "q bigint, m int")
    assert [r[0] for r in q.select(R.spiders_wanted(F.col("q"), F.col("m"))).collect()] == [10, 5, 0, 0, 0]
    assert [r[0] for r in q.select(R.indexers_wanted(F.col("q"), F.col("m"))).collect()] == [1, 8, 10, 10, 5]


def test_feed_orders(spark):
    posts = spark.createDataFrame([(1, 3, 1, 0, 5), (2, 1, 8, 0, 5), (3, 4, 0, 0, 5)], "post_id int, score int, comment_count int, upvote_count int, published_at int")
    assert [r["post_id"] for r in C.ordered(posts, "hot").collect()] == [2, 3, 1]
    assert [r["post_id"] for r in C.ordered(posts, "top").collect()] == [3, 1, 2]
    assert [r["post_id"] for r in C.ordered(posts, "new").collect()] == [3, 2, 1]


def test_visibility(spark):
    posts = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 1, True)], "post_id int, community_id int, is_removed boolean")
    com = spark.createDataFrame([(1, False), (2, True)], "community_id int, is_private boolean")
    mem = spark.createDataFrame([(2, 7), (2, 7)], "community_id int, user_id int")
    ids = lambda v: sorted(r["post_id"] for r in C.visible(posts, com, mem, v).collect())
    assert (ids(None), ids(7), ids(8)) == ([1], [1, 2], [1])


def test_slugs(spark):
    rows = spark.createDataFrame([(1, 1, "Different angle"), (2, 1, "different-angle"), (3, 2, "Different angle"), (4, 1, "Different angle 2"), (5, 1, "???"), (6, 1, None), (7, 1, "different angle!")], "id int, scope int, title string")
    got = {r["id"]: r["slug"] for r in C.slugged(rows, "id", "title", ["scope"], "post").collect()}
    assert got[1] == "different-angle" and got[3] == "different-angle" and got[5] == "post" and got[6] == "post-2"
    assert len({v for k, v in got.items() if k != 3}) == 6
    taken = spark.createDataFrame([(1, "post"), (1, "post-2")], "scope int, slug string")
    assert {r["slug"] for r in C.slugged(rows.where("id in (5, 6)"), "id", "title", ["scope"], "post", taken).collect()} == {"post-3", "post-4"}


def test_slugs_leave_out_taken_numbers(spark, monkeypatch):
    import random

    r = random.Random(4)
    monkeypatch.setattr(C, "KEY_PARTS", 5)
    titles = ["A b", "a b!", "A b 2", "a b 5", "c"]
    rows = [(i, i % 2, r.choice(titles)) for i in range(80)]
    taken = [(0, "a-b"), (0, "a-b-3"), (0, "a-b-4"), (0, "a-b-9"), (1, "a-b-02"), (1, "c-2"), (0, "a-b-5-2")]
    got = {x["id"]: x["slug"] for x in C.slugged(spark.createDataFrame(rows, "id int, scope int, title string"), "id", "title", ["scope"], "post", spark.createDataFrame(taken, "scope int, slug string")).collect()}
    want, used = {}, {*taken}
    base = lambda t: "-".join(t.lower().replace("!", "").split())
    plain = {}
    for i, scope, title in rows:
        plain.setdefault((scope, base(title)), i)
    used |= set(plain)
    for i, scope, title in rows:
        b = base(title)
        if plain[scope, b] == i and (scope, b) not in taken:
            want[i] = b
            continue
        n = 2
        while (scope, f"{b}-{n}") in used:
            n += 1
        want[i] = f"{b}-{n}"
        used.add((scope, want[i]))
    assert got == want


def test_page_rank_of_divided_hubs(spark, monkeypatch):
    import random

    r = random.Random(3)
    pairs = {(0, i) for i in range(1, 30)} | {(r.randrange(30), r.randrange(30)) for _ in range(60)}
    e = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src int, dst int")
    nodes = spark.range(30).selectExpr("cast(id as int) as node")
    whole = {x["node"]: x["rank"] for x in R.page_rank(e, nodes, 4).collect()}
    monkeypatch.setattr(R, "HUB_LINKS", 3)
    for node, rank in [(x["node"], x["rank"]) for x in R.page_rank(e, nodes, 4).collect()]:
        assert rank == pytest.approx(whole[node])


@pytest.mark.parametrize("rows_in_batch", ["10000", "10"])
def test_changed_pages_at_any_batch_size(spark, tmp_path, rows_in_batch):
    from quern.streaming import jobs as J

    kind = "url string, last_crawled string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    marks = [(f"u{i % 3}", f"2024-01-{1 + i * 7 % 20:02}") for i in range(300)]
    spark.createDataFrame(marks, kind).coalesce(1).write.parquet(folder)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows_in_batch)
    try:
        run = lambda: J.run_once(J.changed_pages(J.arriving(spark, folder, "*.parquet", spark.read.parquet(folder).schema)), out, str(tmp_path / "check"))
        run()
        first = [tuple(r) for r in spark.read.parquet(out).collect()]
        assert sorted(first) == sorted(set(marks))
        # the stored mark is the greatest: it is unchanged, any other is a change
        spark.createDataFrame([("u0", max(m for u, m in marks if u == "u0")), ("u1", "2025-01-01"), ("u1", "2025-01-01")], kind).coalesce(1).write.mode("append").parquet(folder)
        run()
        assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted([*set(marks), ("u1", "2025-01-01")])
    finally:
        spark.conf.set(name, before)


def test_backpressure(spark, monkeypatch):
    from quern.streaming import jobs as J

    monkeypatch.setattr(J, "STRETCH", 3)
    waiting = [10, 4999, 5000, 4000, 1, 0, 30, 9000, 1, 1, 1, 1, 0, 4999]
    got = [r["paused"] for r in J.may_crawl(spark.createDataFrame(list(enumerate(waiting)), "seq bigint, waiting bigint")).orderBy("seq").collect()]
    assert got == [False, False, True, True, True, False, False, True, True, True, True, True, False, False]


def test_a_search_is_corrected_and_logged(spark):
    words = spark.createDataFrame([("cat",), ("engine",)], "word string")
    weights = spark.createDataFrame([("u", "engine", 2.0), ("v", "cat", 1.0), ("v", "engine", 1.0)], "url string, word string, weight double")
    meta = spark.createDataFrame([("u", "U", None, "text"), ("v", "V", None, "text")], "url string, title string, description string, summary_text string")
    rank = spark.createDataFrame([("u", 0.9)], "node string, rank double")
    found, log = S.answer(spark, weights, meta, rank, words, "Engin+cat")
    assert [(r["url"], r["match_count"], r["did_you_mean"]) for r in found.orderBy("url").collect()] == [("u", 1, "engine cat"), ("v", 2, "engine cat")]
    assert [r["q"] for r in log.collect()] == ["engine cat"]
    found, log = S.answer(spark, weights, meta, rank, words, "Engin", spell=False)
    assert found.count() == 0 and [r["q"] for r in log.collect()] == ["engin"]
    assert S.answer(spark, weights, meta, rank, words, "  ")[1].count() == 0
    with pytest.raises(ValueError):
        S.search(weights, meta, rank, "cat", per_page=101)


def test_malformed_payloads_are_named(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, "no json"), (3, None), (4, "[1]"), (5, " ")], "key bigint, json string")
    assert {tuple(r) for r in D.malformed(rows).collect()} == {(2, "invalid_json"), (3, "missing_payload"), (5, "missing_payload")}


def test_requests_that_write(spark):
    from quern.operators import writes as N

    com = spark.createDataFrame([(1, "Open", "open", False), (2, "Shut", "shut", True)], "community_id bigint, name string, slug string, is_private boolean")
    mem = spark.createDataFrame([(2, 7), (2, 7)], "community_id bigint, user_id bigint")
    made = {r["request_id"]: r for r in N.create_communities(spark.createDataFrame([(1, 7, "Cats"), (2, 8, "Cats"), (3, 8, "cats!"), (4, 8, "Open"), (5, 8, None), (6, 8, "x" * 121), (7, 9, "open!")], "request_id bigint, user_id bigint, name string"), com).collect()}
    assert [(made[i]["status"], made[i]["reason"], made[i]["slug"]) for i in range(1, 8)] == [(201, None, "cats"), (422, "name_taken", None), (201, None, "cats-2"), (422, "name_taken", None), (422, "name_required", None), (422, "name_too_long", None), (201, None, "open-2")]
    asked = [(1, 8, "shut", "t", "b", "text", None), (2, 7, "shut", "t", "b", "text", None), (3, 7, "none", "t", "b", "text", None), (4, 7, "open", "t", None, "link", "HTTPS://A.org/x#y"), (5, 7, "open", "T", None, "text", None)]
    posts = {r["request_id"]: (r["status"], r["slug"], r["source_url"]) for r in N.create_posts(spark.createDataFrame(asked, "request_id bigint, user_id bigint, community_slug string, title string, body string, content_type string, url string"), com, mem, spark.createDataFrame([(2, "t")], "community_id bigint, slug string")).collect()}
    assert posts == {1: (403, None, None), 2: (201, "t-2", None), 3: (404, None, None), 4: (201, "t", "https://a.org/x"), 5: (422, None, None)}


def test_votes(spark):
    v = spark.createDataFrame([(1, 1, "post", 9, 1, 1), (2, 1, "post", 9, 1, 2), (3, 1, "post", 9, -1, 3), (4, 2, "post", 9, 1, 1), (5, 2, "comment", 9, 1, 1)], "event_id int, user_id int, target_type string, target_id int, value int, ts int")
    assert [r["delta"] for r in R.vote_deltas(v).orderBy("event_id").collect()] == [1, 0, -2, 1, 1]
    assert {tuple(r) for r in C.vote_totals(v).collect()} == {("post", 9, 1, 1, 0), ("comment", 9, 1, 0, 1)}


def test_comment_tree_drops_orphans_and_other_posts(spark):
    c = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 1, 99), (5, 2, 1)], "comment_id int, post_id int, parent_id int")
    assert {(r["comment_id"], tuple(r["path"])) for r in C.comment_paths(c).collect()} == {(1, (1,)), (2, (1, 2)), (3, (1, 2, 3))}
    deep = spark.createDataFrame([(i, 1, i - 1 if i else None) for i in range(12)], "comment_id int, post_id int, parent_id int")
    paths = C.comment_paths(deep)
    assert paths.count() == 9 and C.reply_depth(deep, paths).where("not accepted").count() == 1


def test_directory_dump(spark, tmp_path):
    (tmp_path / "dump.rdf").write_text('<?xml version="1.0"?>\n<RDF xmlns:r="x" xmlns:d="y">\n<ExternalPage r:about="http://www.a.org/x?utm_source=q&b=1#f">\n <d:Title>T1</d:Title>\n <d:Description>D &amp; E</d:Description>\n <topic>Top/Arts/Music</topic>\n</ExternalPage>\n<ExternalPage about="http://b.org/"><Title>T2</Title><topic>Top/Shopping</topic></ExternalPage>\n<ExternalPage about="not-a-url"><Title>T3</Title><topic>Top/News</topic></ExternalPage>\n</RDF>')
    rows = D.read_directory(spark, str(tmp_path / "dump.rdf")).withColumn("reason", D.directory_reason(F.col("topic"), F.col("title"), F.col("url")))
    assert [(r["title"], r["description"], r["reason"]) for r in rows.collect()] == [("T1", "D & E", None), ("T2", "", "excluded_category"), ("T3", "", "invalid_url")]


def test_listing(spark):
    import json

    posts = [("t3", 142, "https://a.org/x", False), ("t3", 500, "https://www.reddit.com/r/x", True), ("t3", 3, "https://b.org", False), ("t1", 99, "https://c.org", False)]
    text = json.dumps([{"kind": "Listing", "data": {"children": [{"kind": k, "data": {"title": "t", "score": s, "url": u, "is_self": z}} for k, s, u, z in posts]}}])
    rows = D.listing_posts(spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "key bigint, json string"))
    assert rows.count() == 3 and [r["canonical"] for r in D.kept_posts(rows).collect()] == ["https://a.org/x"]


def test_topics(spark):
    t = spark.createDataFrame([("Top/Arts/X",), ("Top/Adult",), ("Top/Recreation/Photography/Y",), ("Top/Sports",)], "t string")
    assert [tuple(r) for r in t.select(D.topic_allowed(F.col("t")), D.category_of(F.col("t"))).collect()] == [(True, "Creative & Design"), (False, "General"), (True, "Creative & Design"), (False, "General")]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(W.upserted(old, new, ["k"], "n")) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r[0] for r in rows(W.inserted_if_absent(old, new, ["k"]))] == [1, 2, 3]
    assert rows(W.updated_existing(old, new.where("n = 1"), ["k"], ["v"])) == [(1, "a"), (2, "c")]


def test_image_weights(spark):
    images = spark.createDataFrame([("p", "i/cat.png", "cat-dog.png")], "page_url string, image_url string, filename string")
    words = spark.createDataFrame([("p", "cat", 3), ("p", "sun", 2)], "url string, word string, tf bigint")
    got = lambda wins: {r["word"]: r["weight"] for r in I.image_terms(images, words, wins).collect()}
    assert got(True) == {"cat": 300.0, "sun": 2.0, "dog": 30.0} and got(False) == {"cat": 3.0, "sun": 2.0, "dog": 30.0}


def test_image_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (90).to_bytes(4, "big"))
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + (120).to_bytes(2, "little") + (130).to_bytes(2, "little"))
    (tmp_path / "c.txt").write_bytes(b"none")
    assert sorted((r["width"], r["height"]) for r in W.image_sizes(spark, str(tmp_path)).where("width is not null").collect()) == [(120, 130), (640, 90)]


def test_index_build(spark, data):
    from quern.plans.pipeline import build

    out = build(spark.read.parquet(f"{data}/pages.parquet"))
    assert out["words"].count() > 0 and out["pagerank"].count() == out["edges"].select("src").distinct().count()


def test_plan_of_search_reaches_the_scan(spark, data):
    from quern.bindings import Tables

    plan = Tables(spark, data).documents.where("lang = 'en'").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text:string" not in plan.split("Physical Plan")[1]


def test_published_postings_are_pruned_by_word(spark, data, tmp_path):
    from quern.bindings import Tables
    from quern.plans.pipeline import publish

    t = Tables(spark, data)
    publish(t.words, str(tmp_path / "words"), 4)
    stored = spark.read.parquet(str(tmp_path / "words"))
    assert stored.count() == t.words.count()
    found = S.matches(stored, "thth+ond")
    assert "PushedFilters: [In(word, [ond,thth])]" in found._jdf.queryExecution().toString()


def test_folders_of_a_session(spark):
    from quern.session import new_folder

    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_words_of_pages_are_counted_in_place(spark):
    """Pages of one row each are counted without a shuffle; pages of several rows are still counted together."""
    rows = [("a", "The Sun sun moon. x1 X1 x1"), ("b", None), ("c", ""), ("d", " ".join(f"w{i} w{i % 50}" for i in range(1500))), (None, "sun")]
    docs = spark.createDataFrame(rows, "url string, text string")
    got = lambda d: sorted((r["url"] or "", r["word"], r["tf"]) for r in d.collect())
    found = I.page_postings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == got(I.postings(I.tokens_of(docs))) and ("a", "x1", 3) in got(found) and sum(u == "d" for u, *_ in got(found)) == 1000
    twice = docs.unionByName(docs.limit(1))
    assert got(I.page_postings(twice)) == got(I.postings(I.tokens_of(twice))) and ("a", "x1", 6) in got(I.page_postings(twice))


def test_a_search_makes_the_parts_it_reads(spark, data):
    from quern.bindings import Tables
    from quern.plans.index import Index

    t = Tables(spark, data)
    index = Index(t)
    rows = lambda d: sorted(map(str, d.select("url", "word", "tf", F.round("weight", 9)).collect()))
    assert rows(index.matched("thth+ond of")) == rows(S.matches(t.weights, "thth+ond of")) and rows(index.matched("")) == []
    assert set(index.__dict__) == {"t", "postings", "idf"}
    plan = index.matched("thth+ond")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(word, [ond,thth])" in plan or "PushedFilters: [IsNotNull(word), In(word, [ond,thth])]" in plan
    query, changed = S.asked(spark, index.dictionary, "Thth")
    assert (query, changed) == ("thth", False) and set(index.__dict__) == {"t", "postings", "idf", "dictionary"}
    assert sorted(r[0] for r in index.dictionary.collect()) == sorted(r[0] for r in t.dictionary.collect())


def test_links_are_made_once(spark):
    """The rounds read a table of links; their making, a join in the queries, is not run for each use of them."""
    made = spark.sparkContext.accumulator(0)
    spy = F.udf(lambda x: made.add(1) or x, "bigint")
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src bigint, dst bigint").select(spy("src").alias("src"), "dst")
    got = {r["node"]: r["rank"] for r in R.page_rank(*R.linked_pages(edges), 2).collect()}
    assert made.value == 3 and set(got) == {1, 2, 3}


def test_images_of_several_rows(spark):
    """An image that stands on two pages: the name's weight on one page replaces the other page's, as a full join has it."""
    images = spark.createDataFrame([("p", "i", "cat-dog.png"), ("q", "i", "sun.png"), ("q", "j", "cat.png"), (None, "k", "Dog-dog.gif"), ("p", "l", None)], "page_url string, image_url string, filename string")
    words = spark.createDataFrame([("p", "cat", 3), ("p", "sun", 2), ("q", "cat", 5), ("q", "sun", 7)], "url string, word string, tf bigint")
    got = lambda d: {(r["image_url"], r["word"]): r["weight"] for r in d.collect()}
    found = got(I.image_terms(images, words))
    assert found == {("i", "cat"): 300.0, ("i", "dog"): 30.0, ("i", "sun"): 700.0, ("j", "cat"): 500.0, ("j", "sun"): 7.0, ("k", "dog"): 30.0, ("l", "cat"): 3.0, ("l", "sun"): 2.0}
    assert got(I.image_terms(images, words.where("word = 'cat'"), terms=["cat"])) == {k: v for k, v in found.items() if k[1] == "cat"}
    one = images.where("image_url <> 'i' or page_url = 'p'")
    made = I.image_terms(one, words)
    assert got(made) == {("i", "cat"): 300.0, ("i", "dog"): 30.0, ("i", "sun"): 2.0} | {k: v for k, v in found.items() if k[0] != "i"}
    assert "image_url" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)


def test_titles_are_made_once(spark):
    """slugged() reads its rows as a table; the joins that they come from are not run for each of its steps."""
    made = spark.sparkContext.accumulator(0)
    spy = F.udf(lambda x: made.add(1) or x, "string")
    rows = spark.createDataFrame([(1, 1, "A"), (2, 1, "a"), (3, 1, "b"), (4, 1, "A")], "id int, scope int, title string").select("id", "scope", spy("title").alias("title"))
    assert {r["id"]: r["slug"] for r in C.slugged(rows, "id", "title", ["scope"], "post").collect()} == {1: "a", 2: "a-2", 3: "b", 4: "a-3"}
    assert made.value == 4
