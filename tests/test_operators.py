"""Rules and quirks on literal rows."""

from pyspark.sql import functions as F

from ragmill.functions import text as T
from ragmill.operators import catalog, chunk, evaluate, extract, feedback, fusion, jobs, rerank, retrieve, tags


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_segments_fences_and_tables(spark):
    text = "intro\n\n```py\nx = 1\n\ny = 2\n\n```\n\na | b\nc | d\n\nonly | one\n\n```open\n\nrest"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    got = [(r.type, r.text) for r in chunk.segments(chunk.paragraphs(docs)).orderBy("pos").collect()]
    assert got == [("paragraph", "intro"), ("code_block", "```py\nx = 1\ny = 2\n```"), ("table", "a | b\nc | d"), ("paragraph", "only | one"), ("code_block", "```open\nrest")]


def pack(spark, rows, **sizes):
    segs = spark.createDataFrame([(1, i, t, k, p) for i, (t, k, p) in enumerate(rows)], "document_id long, pos int, text string, type string, page int")
    return [(r.content, r.type, r.page) for r in chunk.pack(segs, **sizes).orderBy("chunk_index").collect()]


def test_pack_overlap_keeps_the_head_and_next_type(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    got = pack(spark, [(a, "paragraph", 1), (b, "paragraph", 2), (c, "paragraph", 3)], target=15, overlap=5)
    assert got == [(a, "paragraph", 2), ("a" * 20 + "\n\n" + b, "paragraph", 3), ("b" * 20 + "\n\n" + c, None, None)]


def test_pack_long_segment_leaves_carried_text_for_later(spark):
    long = "First sentence here is long. Second sentence here too."
    got = pack(spark, [("a" * 32, "paragraph", 1), (long, "paragraph", 2)], target=10, overlap=2)
    assert got == [("a" * 32, "paragraph", 2), ("First sentence here is long.", "paragraph", 2), ("Second sentence here too.", "paragraph", 2), ("a" * 8, None, None)]


def test_pack_tables_stay_whole(spark):
    table = "x | y\n" * 10
    assert pack(spark, [("p", "paragraph", 1), (table, "table", 2)], target=10)[:2] == [("p", "table", 2), (table, "table", 2)]


def test_split_long(spark):
    assert one(spark, chunk.split_long(F.col("t"), 3), t="One two. Three！Four five six.") == ["One two.Three！", "Four five six."]
    assert one(spark, chunk.split_long(F.col("t"), 100), t="no end") == ["no end"]


def test_sentences_merge_short_ones(spark):
    assert one(spark, T.sentences(F.col("t")), t="This is a first sentence. Short. And a second sentence.") == ["This is a first sentence.Short.", "And a second sentence."]
    assert one(spark, T.sentences(F.col("t")), t="ab. c") == []


def test_reply_parsing(spark):
    assert one(spark, T.parse_queries(F.col("t")), t='1. "what is it"\n2、how so\nab\n3) third one\nfourth') == ["what is it", "how so", "third one"]
    assert one(spark, T.parse_claims(F.col("t")), t='1- "one fact"\n- second fact\nno') == ["one fact", "second fact"]
    assert one(spark, T.parse_tags(F.col("t")), t='1. Spark，"数据"、x, Spark\n模型。') == ["Spark", "数据", "模型"]
    assert one(spark, T.parse_list(F.col("t"), 2), t="a, b，c") == ["a", "b"]
    assert one(spark, tags.quality_filter(F.split("t", ",")), t="文档,Spark,Report,12,x,Spark,SQL") == ["Spark", "SQL"]


def test_scores_with_and_without_json(spark):
    ids = [{"short": "c1", "full": "A"}, {"short": "c2", "full": "B"}]
    rows = [(1, 'ok {"scores": [{"id": "c1", "score": 120}, {"id": "zz", "score": 3}]}', ids), (2, "c1: 77 good", ids)]
    df = spark.createDataFrame(rows, "query_id long, raw string, ids array<struct<short:string,full:string>>")
    got = {(r.query_id, r.id): r.score for r in rerank.parse_scores(df).collect()}
    assert got == {(1, "A"): 100.0, (1, "zz"): 3.0, (2, "A"): 77.0, (2, "B"): 50.0}


def test_rerank_few_candidates_pass_and_equal_scores_are_half(spark):
    schema = "query_id long, id string, rank int, score double, raw double"
    few = spark.createDataFrame([(1, "a", 1, None, 1.0), (1, "b", 2, 0.9, 9.0)], schema)
    assert [(r.id, r.rerank_score) for r in rerank.rerank(few, 5).orderBy("rank").collect()] == [("a", 0.5), ("b", 0.9)]
    same = spark.createDataFrame([(1, x, i, 0.1, 4.0) for i, x in enumerate("cab", 1)], schema)
    assert [(r.id, r.rerank_score) for r in rerank.rerank(same, 2).orderBy("rank").collect()] == [("a", 0.5), ("b", 0.5)]


def test_multi_query_doubles_the_first_list_that_is_not_empty(spark):
    rows = [(1, 1, 1, "x", 0.5), (1, 2, 1, "y", 0.4), (2, 3, 1, "z", 0.3)]
    got = {(r.query_id, r.id): r.rrf for r in fusion.multi_query(spark.createDataFrame(rows, "query_id long, list_id int, rank int, id string, score double")).collect()}
    assert got == {(1, "x"): round(2 / 61, 6), (1, "y"): round(1 / 61, 6), (2, "z"): None}


def test_linear_with_one_side_and_equal_scores(spark):
    s = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.7)], "query_id long, id string, score double")
    b = spark.createDataFrame([(1, "c", 3.0), (1, "a", 1.0)], "query_id long, id string, score double")
    assert [(r.id, r.fused) for r in fusion.linear(s, b).orderBy("rank").collect()] == [("a", 0.7), ("b", 0.7), ("c", 0.3)]


def test_hard_truncate_at_exactly_200_and_201(spark):
    for left, kept in ((200, 1), (201, 2)):
        parts = spark.createDataFrame([(1, 1, "a" * (1000 - left)), (1, 2, "b" * 500), (1, 3, "c")], "query_id long, pos int, content string")
        assert retrieve.hard_truncate(parts, 1000).count() == kept


def test_compression_keeps_short_sentences_or_all(spark):
    parents = spark.createDataFrame([(1, 1, "Completely different words in this long sentence here. Paid 12 Euro. Spark joins tables over the network quickly today."), (1, 2, "Just one sentence that has nothing of it")], "query_id long, pos int, content string")
    queries = spark.createDataFrame([(1, "how Spark joins tables")], "query_id long, text string")
    got = {r.pos: r for r in retrieve.compress(parents, queries).collect()}
    assert got[1].content == "Paid 12 Euro.Spark joins tables over the network quickly today." and got[1].kept == 2
    assert got[2].content.startswith("Just one") and got[2].total == 1


def test_ragas_edges(spark):
    rows = spark.createDataFrame([(1, 0, "是"), (2, 1, "是\n是"), (3, None, "是"), (4, 2, None)], "case_id long, n_claims int, raw string")
    assert {r.case_id: r.f for r in evaluate.supported_share(rows, "f").collect()} == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}
    replies = spark.createDataFrame([(1, "相关\n不相关\nx\n相关\n相关", 3), (2, "相关", 3), (3, None, 3)], "case_id long, raw string, n_contexts int")
    got = {r.case_id: r.context_precision for r in evaluate.batch_precision(replies).collect()}
    assert got == {1: round((1 + 1 / 3 + 1 / 4) / (1 + 1 / 2 + 1 / 3 + 1 / 4), 6), 2: round(1 / (1 + 1 / 2 + 1 / 3), 6), 3: 0.5}
    ents = spark.createDataFrame([(1, "a，b", "b、c"), (2, " ", "x"), (3, None, "x")], "case_id long, truth string, context string")
    assert {r.case_id: r.entity_recall for r in evaluate.entity_recall(ents).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_feedback_second_vote_without_comment(spark):
    rows = [(1, 5, 7, 1, "up", "nice", "2024-01-01 00:00:00"), (2, 5, 7, -1, "down", "", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, message_id long, user_id long, rating int, feedback_type string, comment string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = feedback.upsert(df).first()
    assert (r.rating, r.feedback_type, r.comment) == (-1, "down", "nice")
    s = feedback.stats(df, "2030-01-01 00:00:00").first()
    assert (s.total, s.avg_rating, s.positive_rate) == (0, 0.0, 0.0)


def test_outbox_backoff_and_dead_letters(spark):
    rows = [(1, "PROCESSING", 7), (2, "PROCESSING", 9), (3, "PROCESSING", 0)]
    df = spark.createDataFrame(rows, "id long, status string, attempts int")
    got = {r.id: (r.status, r.attempts, r.delay_s) for r in jobs.reschedule(df, df.where("id < 3"), "2024-01-01 00:00:00").collect()}
    assert got == {1: ("PENDING", 8, 256), 2: ("DEAD", 10, None), 3: ("PUBLISHED", 0, None)}


def test_sse_and_assembly(spark):
    log = spark.createDataFrame([(1, 1, 'data: {"text":"a"}'), (1, 2, "data: {bad"), (1, 3, "data: [DONE]"), (1, 4, 'data: {"text":"late"}'), (2, 1, "data: [DONE]")], "request_id long, seq long, line string")
    assert {r.request_id: r.text for r in jobs.parse_sse(log).collect()} == {1: "a", 2: ""}


def test_gate_and_guard(spark):
    files = spark.createDataFrame([("a/b.TXT", 1), ("x.exe", 1), ("y.md", 60 << 20), ("none", 1)], "original_filename string, file_size long")
    assert [(r.safe_name, r.reject_reason) for r in catalog.gate(files).collect()] == [("a_b.TXT", None), ("x.exe", "extension"), ("y.md", "size"), ("none", "extension")]
    kbs = spark.createDataFrame([(1, 10)], "kb_id long, user_id long")
    req = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 10, 9)], "request_id long, user_id long, kb_id long")
    assert {r.request_id: r.status for r in retrieve.guard(req, kbs).collect()} == {1: 200, 2: 403, 3: 404}


def test_extraction(spark):
    html = "<html><head><title> T </title></head><body><nav><a>menu</a></nav><h2>Head</h2><p>One<br>two</p>" + "".join(f'<div class="card-item"><h3>Item {i}</h3><p>{"word " * 10}</p></div>' for i in range(3)) + "<script>x()</script></body></html>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in extract.structured(pages).collect()}
    assert "## Head" in text[1] and "One\ntwo" in text[1] and "x()" not in text[1] and text[2] == ""
    cards = extract.cards(pages).first()
    assert (cards["class"], cards.n_cards) == ("card-item", 3) and cards.text.startswith("## Item 0\nword")
    assert extract.main_content(pages).where("page_id = 1").first().title == "T"


def test_threshold_is_applied_after_the_cut(spark):
    from ragmill.operators import vectors

    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id long, kb_id int, embedding array<double>")
    v = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(4)], "kb_id int, id long, embedding array<double>")
    assert [r.id for r in vectors.search(q, v, 2, 0.9).orderBy("rank").collect()] == [0]
    plan = vectors.search(q, v, 2, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("score") < plan.index("Window")


def test_terms_of_scripts_without_spaces(spark):
    from ragmill.functions.text import terms

    rows = ["plain Words, 2 of them", "检索增强 RAG生成x", "字", "かな カ", "", "a-b日本語c"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(terms(F.col("x")).alias("t")).collect()]
    assert got == [["plain", "Words", "2", "of", "them"], ["检索", "索增", "增强", "RAG", "生成", "x"], ["字"], ["かな", "カ"], [], ["a", "b", "日本", "本語", "c"]]


def test_cards_of_nested_classes_titles_and_ties(spark):
    from ragmill.operators import extract

    item = '<li class="job-item {x}"><span class="jobName">Job {i}</span><p>words of the job number {i}, long enough</p></li>'
    many = "".join(item.format(i=i, x="hot" if i == 9 else "").replace(' "', '"') for i in (1, 2, 3, 9))
    spans = "".join(f'<span class="spanclass"><b>a</b><i>{i}</i> over thirty characters of text here</span>' for i in range(9))
    thin = "".join('<div class="single-child"><p>one child only, over thirty characters of text</p></div>' for _ in range(9))
    html = f"<html><body><ul>{many}</ul>{spans}{thin}</body></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no classes</p>")], "page_id long, html string")
    row = extract.cards(pages).collect()
    assert [(r.page_id, r["class"], r.n_cards) for r in row] == [(1, "job-item", 4)]
    parts = row[0].text.split("\n\n---\n\n")
    assert parts[0] == "## Job 1\nwords of the job number 1, long enough" and parts[3].startswith("## Job 9")


def test_touched_and_unlink(spark):
    from ragmill.operators import catalog

    before = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "document_id long, kb_id int")
    after = catalog.link(catalog.unlink(before, before.where("document_id = 1")), spark.createDataFrame([(3, 8), (3, 9)], "document_id long, kb_id int"))
    assert sorted(r.kb_id for r in catalog.touched(before, after).collect()) == [7, 9]


def test_copy_to_kb_skips_documents_that_are_there(spark):
    from ragmill.operators import vectors

    index = spark.createDataFrame([(1, 3, 10)], "document_id long, kb_id int, vec_id long")
    links = spark.createDataFrame([(1, 3), (1, 4), (1, 4), (2, 4), (5, 4), (1, None)], "document_id long, kb_id int")
    own = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "document_id long, vec_id long")
    got = sorted(tuple(r) for r in vectors.copy_to_kb(index, links, own).collect())
    assert got == [(1, 3, 10), (1, 4, 10), (1, 4, 11), (2, 4, 20)]
