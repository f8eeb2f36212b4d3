"""Golden cases of the retrieval engine."""

import json
import unicodedata
import uuid

import pytest
from corpusloom import cli
from corpusloom.config import ChunkConfig, CitationConfig, ContextConfig, RetrievalConfig, TokenizerConfig
from corpusloom.functions import text as T
from corpusloom.functions import udf
from corpusloom.operators import bm25, citations, fusion, metrics, models, planning, selection, submission
from corpusloom.plans import corpus, retrieval
from corpusloom.sources import readers, writers
from corpusloom.streaming import answers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, make, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return row.select(make(*[F.col(k) for k in values]).alias("x")).first()["x"]


def test_settings_are_checked():
    for make in (lambda: ChunkConfig(max_chars=0), lambda: RetrievalConfig(sparse_weight=0), lambda: TokenizerConfig(phrase_boost=-1), lambda: CitationConfig(score_margin=-1), lambda: ContextConfig(total=0)):
        with pytest.raises(ValueError):
            make()


def test_query_text(spark):
    raw = unicodedata.normalize("NFD", " công ty  TNHH không được theo khoản2 điều47, 123 / 2020 / NĐ - CP ")
    assert one(spark, T.query_text, q=raw) == "công ty trách nhiệm hữu hạn không được theo Khoản 2 Điều 47, 123/2020/NĐ-CP"


def test_tokens_of_a_wrongly_decoded_text(spark):
    wrong = "doanh nghiệp góp vốn".encode().decode("latin1")
    assert one(spark, T.tokenize, t=wrong) == ["doanh", "nghiệp", "góp", "vốn", "doanh_nghiệp", "góp_vốn"]
    assert one(spark, T.tokenize, t=None) == []


def test_ids(spark):
    assert one(spark, T.uuid5, t="điều 1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "điều 1"))
    assert len(one(spark, lambda a, b: T.content_id(a, b), a="x", b=" y\n z ")) == 32
    with pytest.raises(Exception, match="identity"):
        one(spark, lambda a, b: T.content_id(a, b), a="x", b="  ")


def test_clean_text(spark):
    assert one(spark, T.clean_text, t="﻿a \t b\r\n  c  \r\n\n\n\nd ") == "a b\nc\n\nd"


@given(st.text(alphabet="ab. \n;", max_size=400), st.integers(5, 60))
@settings(max_examples=80, deadline=None)
def test_spans_cover_a_text(text, size):
    text = text.strip()
    spans = udf.long_spans(text, ChunkConfig(size, size // 4, size // 3))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(b > a for a, b in spans) and all(b - a <= size for a, b in spans[:-1])


def test_segments(spark):
    got = one(spark, T.legal_segments, t="Mở đầu\n1. Một: a) x; b) y\n2. Hai")
    assert [(s["kind"], s["clause"], s["point"]) for s in got] == [("article", None, None), ("clause", "1", None), ("point", "1", "a"), ("point", "1", "b"), ("clause", "2", None)]


def test_fusion_order(spark):
    rows = [(0, "c1", 1, 1.0), (0, "c2", 2, 1.0), (0, "c2", 1, 0.7), (0, "c3", 2, 0.7)]
    got = fusion.fuse(spark.createDataFrame(rows, "query_id int, item_id string, rank int, weight double")).orderBy(F.desc("rrf")).collect()
    assert [(r["item_id"], round(r["rrf"], 6)) for r in got] == [("c2", 0.027604), ("c1", 0.016393), ("c3", 0.01129)]


def test_early_stop_leaves_no_trace(spark):
    rows = [(0, 0, 0, i, c, f"k{i}") for i, c in enumerate(["a", "a", "b", "b", "c"], 1)]
    hits = spark.createDataFrame(rows, "query_id int, variant int, modality int, raw_rank int, content_id string, chunk_id string")
    unique = fusion.first_occurrences(hits, 2)
    kept = fusion.representatives(fusion.contributing(hits, unique, 2)).orderBy("content_id").collect()
    assert [(r["content_id"], r["chunk_ids"]) for r in kept] == [("a", ["k1", "k2"]), ("b", ["k3"])]


def test_scoped_selection(spark):
    rows = [(0, "one", "a1", 0.95, 0.0, 1, ["s1"]), (0, "two", "a2", 0.96, 0.0, 2, ["s2"]), (0, "stock", "a3", 0.94, 0.0, 3, ["s3"]), (0, "n1", "a4", 0.2, 0.0, 4, ["s1"]), (0, "n2", "a1", 0.1, 0.0, 5, [])]
    df = spark.createDataFrame([(*r, ["s1", "s2", "s3"]) for r in rows], "query_id int, content_id string, article_id string, relevance double, rrf double, pool_pos int, matched_scopes array<string>, required_scopes array<string>")
    got = selection.select_scoped(df, 5, 1, True, 0.15).orderBy("position").collect()
    assert [r["content_id"] for r in got] == ["two", "one", "stock"]


def test_ranking(spark):
    rows = spark.createDataFrame([("c", ["x", "b", "a", "z"], ["a", "b"])], "case_id string, retrieved array<string>, relevant array<string>")
    got = metrics.ranking(rows, (1, 2, 3)).orderBy("cutoff").collect()
    assert [(r["recall"], r["mrr"]) for r in got] == [(0, 0), (0.5, 0.5), (1, 0.5)]


def test_set_scores(spark):
    kind = "id int, relevant_docs array<string>, relevant_articles array<string>"
    gold = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], [])], kind)
    pred = spark.createDataFrame([(1, ["a", "c"], ["x"]), (9, ["q"], [])], kind)
    got = {r["field"]: r for r in metrics.answer_sets(pred, gold).collect()}
    assert got["relevant_docs"]["precision"] == 0.75 and got["relevant_articles"]["f2"] == 1.0


def test_citation_quotas(spark):
    q = spark.createDataFrame([("s", "vốn điều lệ là gì"), ("m", "thuế ra sao và phải nộp gì")], "query_id string, question string")
    hits = [(x, i, 1.0 - i / 10, "L1", "T L1", f"Điều {i}") for x in "sm" for i in range(1, 7)]
    got = {r["query_id"]: r for r in citations.select(q, spark.createDataFrame(hits, "query_id string, rank int, score double, code string, title string, article string")).collect()}
    assert len(got["s"]["relevant_articles"]) == 2 and len(got["m"]["relevant_articles"]) == 5 and got["m"]["relevant_docs"] == ["L1|T L1"]
    margin = citations.select(q, spark.createDataFrame([("s", 1, 0.9, "A", "T A", "Điều 1"), ("s", 2, 0.84, "B", "T B", "Điều 2")], "query_id string, rank int, score double, code string, title string, article string"), CitationConfig(score_margin=0.05))
    assert margin.where("query_id = 's'").first()["relevant_articles"] == ["A|T A|Điều 1"]


def answer(query_type="legal_concept", variants=(), subs=(), terms=(), **analysis):
    base = {"intent": "definition", "query_type": query_type, "legal_domain": None, "entities": [], "company_type": None, "article_number": None, "clause_number": None, "document_number": None, "temporal_scope": "current", "must_terms": []}
    return json.dumps({"analysis": base | analysis, "semantic_variants": [{"text": t, "kind": k, "reason": "r"} for t, k in variants], "subqueries": [{"text": t, "reason": "r"} for t in subs], "lexical_terms": list(terms)}, ensure_ascii=False)


def plan(spark, query, raw):
    rows = spark.createDataFrame([(1, query, raw)], "query_id long, query string, raw string")
    return planning.build(planning.draft(rows)).first()


def test_plans(spark):
    fallback = plan(spark, "vốn là gì", "no json")
    assert [v["text"] for v in fallback["semantic_queries"]] == ["vốn là gì"] and fallback["warning"]
    fake = plan(spark, "vốn là gì", answer(entities=[{"value": "x", "evidence": "not there"}], variants=[("vốn", "semantic")]))
    assert len(fake["semantic_queries"]) == 1 and fake["warning"]
    exact = plan(spark, "Khoản 2 Điều 47 quy định gì", answer("exact_lookup", article_number={"value": "47", "evidence": "Điều 47"}))
    assert exact["warning"] is None and len(exact["semantic_queries"]) == 1 and exact["query_type"] == "exact_lookup"
    scopes = [("góp vốn công ty trách nhiệm hữu hạn một thành viên", "scope"), ("góp vốn công ty trách nhiệm hữu hạn hai thành viên", "scope"), ("góp vốn công ty cổ phần", "scope")]
    wide = plan(spark, "góp vốn", answer("ambiguous", scopes))
    assert [v["scope"] for v in wide["semantic_queries"]] == [None, "limited_liability_one_member", "limited_liability_two_or_more", "joint_stock"]
    negated = plan(spark, "không được góp vốn", answer(variants=[("được góp vốn", "semantic"), ("không được góp phần vốn", "semantic")]))
    assert [v["text"] for v in negated["semantic_queries"]] == ["không được góp vốn", "không được góp phần vốn"]
    numbers = plan(spark, "mức phạt", answer(variants=[("mức phạt 50", "semantic"), ("phạt tiền", "semantic")], terms=["mức phạt", "điều 5"]))
    assert len(numbers["semantic_queries"]) == 2 and numbers["lexical_terms"] == ["mức phạt"]
    many = plan(spark, "thuế và đất", answer("multi_issue", subs=["thuế", "đất", "phí"]))
    assert len(many["subqueries"]) == 2


def test_hybrid_retrieval_with_scopes(spark):
    texts = {"one": "góp vốn công ty trách nhiệm hữu hạn một thành viên", "stock": "góp vốn công ty cổ phần", "x": "thuế đất", "copy": "thuế  đất"}
    rows = [(i, k, f"a{i}" if k != "copy" else "a2", t) for i, (k, t) in enumerate(texts.items())]
    embed = models.embedder_udf(lambda: models.HashingEmbedder(32))
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, article_id string, text string").withColumn("embedding", embed("text"))
    raw = answer("ambiguous", [(texts["one"], "scope"), (texts["stock"], "scope")])
    plans = planning.build(planning.draft(spark.createDataFrame([(1, "góp vốn", raw), (2, "thuế đất", "")], "query_id long, query string, raw string")))
    got = retrieval.hybrid(plans, chunks, bm25.build_index(chunks), embed, 3, rerank=models.reranker_udf(models.OverlapReranker)).orderBy("query_id", "position").collect()
    first = [r for r in got if r["query_id"] == 1]
    assert {r["chunk_id"] for r in first} == {"one", "stock"}
    second = next(r for r in got if r["query_id"] == 2)
    assert second["chunk_id"] == "copy" and second["chunk_ids"] == ["copy", "x"]


def test_records(spark, tmp_path):
    asked = spark.createDataFrame([(2, "q2", 0), (1, "q1", 1)], "id bigint, question string, pos int")
    made = lambda part: part.select("id", "question", F.lit("a").alias("answer"), F.array(F.lit("L1|T L1")).alias("relevant_docs"), F.array(F.lit("L1|T L1|Điều 4")).alias("relevant_articles"))
    out = answers.generate(spark, asked, str(tmp_path / "work"), readers.RECORD, made, 1)
    assert [r["id"] for r in out.collect()] == [2, 1]
    again = answers.generate(spark, asked, str(tmp_path / "work"), readers.RECORD, lambda part: 1 / 0, 1)
    file, archive = writers.submission(again, str(tmp_path / "out"))
    writers.check_zip(archive, file.read_bytes())
    assert readers.records(spark, str(file)).count() == 2
    with pytest.raises(ValueError, match="missing"):
        submission.validate(out.where("id = 1"), asked)


def test_context_budget(spark):
    items = spark.createDataFrame([([("aaaa", None), ("bbbb", "H"), ("cccc", None)],)], "items array<struct<text: string, heading: string>>")
    assert items.select(submission.render_context(F.col("items"), ContextConfig(3, 21)).alias("x")).first()["x"] == "[Căn cứ 1]\naaa\n\n[H]\nbbb"


def test_collection_and_shards(spark, tmp_path):
    for n, v in ((0, 1.0), (1, 2.0)):
        spark.createDataFrame([(f"p{n}", [v, 0.0], f"c{n}", "t")], "point_id string, vector array<double>, chunk_id string, text string").coalesce(1).toPandas().to_parquet(tmp_path / f"embedded_{n}.parquet")
    store = writers.Collection(spark, str(tmp_path / "c"), 2)
    from corpusloom.config import ImportConfig

    assert corpus.import_vectors(spark, str(tmp_path), store, ImportConfig(dim=2))["count"] == 2
    assert corpus.import_vectors(spark, str(tmp_path), store, ImportConfig(dim=2, start_file=1))["count"] == 2
    with pytest.raises(ValueError, match="components"):
        writers.Collection(spark, str(tmp_path / "c"), 3).ensure()


def test_retries():
    waits, left = [], [3]

    def write():
        left[0] -= 1
        if left[0]:
            raise OSError

    models.with_retries(write, 5, waits.append)
    assert waits == [1, 2]


def test_json_stop_rule():
    assert udf.json_object_complete('x {"a": "}"} y') and not udf.json_object_complete('{"a": {') and not udf.json_object_complete("none")


def test_command_line():
    a = cli.parser().parse_args(["postprocess", "in.json", "out", "--multi", "2", "4"])
    assert a.multi == [2, 4] and a.run is cli.postprocess


def test_commands_from_corpus_to_answers(spark, tmp_path, capsys):
    """Every command on a small corpus, each on what the one before has left."""
    notes = [(f"Điều {i}", f"(Điều {i} Luật số 3{i}/2004/QH11 Tên luật ngày 03/12/2004)", f"1. nội dung số{i} về vốn\n2. thuế đất số{i}") for i in range(1, 7)]
    spark.createDataFrame(notes, "article_title string, source_note_text string, text string").write.parquet(str(tmp_path / "raw"))
    run = lambda *args: (cli.main([str(a) for a in args]), capsys.readouterr().out)[1]
    assert "'chunks': 12" in run("ingest", tmp_path / "raw", tmp_path / "corpus")
    run("build-index", tmp_path / "corpus/chunks", tmp_path / "index")
    found = json.loads(run("retrieve", "nội dung số3", tmp_path / "corpus/chunks", "--index", tmp_path / "index", "--top-k", 2))
    assert [q["kind"] for q in found["query_plan"]["semantic_queries"]] == ["original", "semantic"] and "số3" in found["hits"][0]["text"]
    alone = json.loads(run("retrieve", "nội dung số3", tmp_path / "corpus/chunks", "--mode", "baseline", "--top-k", 1))
    assert len(alone["query_plan"]["semantic_queries"]) == 1 and len(alone["hits"]) == 1
    articles = spark.read.parquet(str(tmp_path / "corpus/articles"))
    of = {r["article_title"]: r["article_id"] for r in articles.collect()}
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps({"query": f"nội dung số{i}", "relevant_article_ids": [of[f"Điều {i}"]]}) for i in (2, 5)))
    assert run("evaluate-retrieval", tmp_path / "cases.jsonl", tmp_path / "corpus/chunks", "--index", tmp_path / "index", "--cutoffs", "5,1,5").split()[3:5] == ["1", "1.0000"]
    with pytest.raises(SystemExit):
        cli.cutoffs_of("1,x")
    asked = [{"id": i, "question": f"nội dung số{i} là gì"} for i in (4, 2)]
    (tmp_path / "asked.json").write_text(json.dumps(asked, ensure_ascii=False))
    said = run("generate", tmp_path / "asked.json", tmp_path / "corpus/articles", tmp_path / "work", tmp_path / "out", tmp_path / "corpus/chunks", "--index", tmp_path / "index")
    assert "2 of 2" in said
    records = json.loads((tmp_path / "out/results.json").read_text())
    assert [r["id"] for r in records] == [2, 4] and records[0]["answer"] and records[0]["relevant_articles"][0].startswith("32/2004/QH11|Luật 32/2004/QH11 Tên luật|Điều 2")
    assert "relevant_articles: " in run("postprocess", tmp_path / "out/results.json", tmp_path / "filtered", "--simple", 1, 1)
    assert run("validate", tmp_path / "filtered/results.json", tmp_path / "asked.json").strip() == "valid"
    assert "f2" in run("score", tmp_path / "filtered/results.json", tmp_path / "out/results.json")


def test_index_keeps_its_settings(spark, tmp_path):
    from corpusloom.config import TokenizerConfig

    docs = spark.createDataFrame([(1, "Vốn Điều Lệ"), (2, "vốn")], "doc_id long, text string")
    built = bm25.build_index(docs, tokenizer=TokenizerConfig(phrases=("vốn điều lệ",), phrase_boost=2, lowercase=True), path=str(tmp_path / "i"))
    loaded = bm25.load_index(spark, str(tmp_path / "i"))
    assert loaded.tokenizer == built.tokenizer and loaded.tokenizer.phrases == ("vốn điều lệ",)
    found = bm25.search(loaded, spark.createDataFrame([(7, "vốn điều lệ")], "query_id long, text string"), 5).collect()
    assert [r["doc_id"] for r in found] == [1, 2]
    assert "vốn_điều_lệ" in {r["term"] for r in bm25.query_terms(spark.createDataFrame([(7, "vốn điều lệ")], "query_id long, text string"), loaded.tokenizer).collect()}


def test_plans_scan_no_text_twice(spark, tmp_path):
    """What a search reads is the index, not the documents again."""
    docs = spark.createDataFrame([(1, "vốn điều lệ"), (2, "vốn")], "doc_id long, text string")
    index = bm25.build_index(docs, path=str(tmp_path / "i"))
    found = bm25.search(index, spark.createDataFrame([(7, "vốn")], "query_id long, text string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("ArrowEvalPython") <= 2  # one scan of each table of the index


def test_planner_repairs_once(spark):
    from corpusloom.plans import planner
    from corpusloom.plans.catalog_planning import FaultyPlanner

    rows = spark.createDataFrame([(i, f"vốn số {i}") for i in range(8)], "query_id long, query string")
    got = {r["query_id"]: r for r in planner.plan(rows, FaultyPlanner, 3).collect()}
    assert {i for i, r in got.items() if r["warning"]} == {3, 6, 7} and {i for i, r in got.items() if len(r["semantic_queries"]) == 2} == {0, 1, 2, 4, 5}


def test_collection_versions(spark, tmp_path):
    store = writers.Collection(spark, str(tmp_path / "c"), 2)
    store.ensure()
    kind = "point_id string, chunk_id string, embedding array<float>"
    put = lambda *rows: store.upsert(spark.createDataFrame(list(rows), kind))
    assert put(("a", "1", [1.0, 0.0]), ("b", "2", [1.0, 0.0])) == 2 and put(("a", "3", [0.0, 1.0])) == 1
    assert {(r["point_id"], r["chunk_id"]) for r in store.read().collect()} == {("a", "3"), ("b", "2")}
    store.create_payload_indexes("chunk_id")
    store.create_payload_indexes("chunk_id")
    assert store.count() == 2 and store.payload_indexes() == ["chunk_id"]
    store.set_indexing_threshold(2)
    put(("c", "4", [0.0, 1.0]), ("b", "5", [0.0, 1.0]))
    assert store.count() == 3 and len(store._state()[1]) == 1  # merged into one base
    with pytest.raises(Exception, match="expected 2"):
        put(("d", "6", [1.0]))


def test_ranks_of_large_groups(spark):
    from corpusloom.operators import ranking

    rows = spark.createDataFrame([("g", i * 7 % 50, i) for i in range(200)], "k string, n int, id int")
    got = {r["id"]: r["rank"] for r in ranking.numbered(rows, ("k",), -F.col("n"), "id").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(200), key=lambda i: (-(i * 7 % 50), i)) and sorted(got.values()) == list(range(1, 201))


def test_dense_search_in_blocks(spark, monkeypatch):
    """Queries beyond a block's size are dealt to several; the result is the same."""
    import numpy as np
    from corpusloom.operators import dense

    x = np.random.default_rng(2).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    find = lambda: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in dense.search(rows, asked, 3).collect())
    whole = find()
    monkeypatch.setattr(dense, "BLOCK_FLOATS", 40)
    assert find() == whole and len(whole) == 60


def test_dense_search_holds_one_tile_of_products(spark, monkeypatch):
    """A task never holds the products of all queries with all vectors of a batch; ties, signs and missing numbers as before."""
    import numpy as np
    from corpusloom.operators import dense

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(400, 4)).astype(float)  # many equal scores
    x[5] = 0
    ids = rng.permutation(400).astype(np.int64)
    monkeypatch.setattr(dense, "TILE_FLOATS", 700)
    monkeypatch.setattr(dense, "TILE_VECTORS", 70)
    seen, merge = [], dense._merge
    monkeypatch.setattr(dense, "_merge", lambda best, near, *rest: (seen.append(near.size), merge(best, near, *rest))[1])
    import pyarrow as pa

    bad = np.vstack([x, [[np.nan] * 4]])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.append(ids, 400)[a : a + 150]), pa.array(bad[a : a + 150].tolist())], names=["vec_id", "embedding"]) for a in range(0, 401, 150)]
    block = type("B", (), {"value": (ids, dense._unit(x))})
    for other in (False, True):
        got = [r for b in dense._scan(block, 6, True, other)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        scores = np.round(dense._unit(x) @ dense._unit(x).T, dense.PLACES)
        want = [(int(ids[i]), *r) for i in range(400) for r in sorted(((int(ids[j]), float(scores[i, j])) for j in range(400) if not other or i != j), key=lambda r: (-r[1], r[0]))[:6]]
        assert got == want
    assert max(seen) <= 700 and len(seen) > 400


def test_sparse_search_in_blocks_and_tiles(spark, monkeypatch):
    """No row for a pair of query and document: tasks keep k rows a query, whatever the blocks and tiles; documents that are
    dealt to several batches, rows with one id and empty texts count as in plain sums."""
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    words = [f"w{i}" for i in range(12)]
    texts = [(i % 90, " ".join(words[(i * j * 7 + j) % 12] for j in range(i % 9))) for i in range(95)]  # five ids occur twice
    asked = [(i, " ".join(words[(i + j * j) % 12] for j in range(1 + i % 5))) for i in range(30)]
    index = bm25.build_index(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    counts = {}
    for i, t in texts:
        counts.setdefault(i, Counter()).update(t.split())
    df, mean = Counter(w for c in counts.values() for w in c), sum(len(t.split()) for _, t in texts) / len(texts)
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    want = []
    for q, text in asked:
        found = []
        for i, c in counts.items():
            lengths, first = [len(t.split()) for j, t in texts if j == i], [p for p, w in enumerate(text.split()) if c[w]]
            score = sum(n * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / mean)) for w, n in Counter(text.split()).items() if c[w] for dl in lengths)
            found += [(-round(score, 6), first[0], i)] if first else []
        want += [(q, i, rank, -s) for rank, (s, _, i) in enumerate(sorted(found)[:4], 1)]
    search = lambda: sorted((r["query_id"], r["doc_id"], r["rank"], r["score"]) for r in bm25.search(index, spark.createDataFrame(asked, "query_id long, text string"), 4).collect())
    close = lambda a, b: [x[:3] for x in a] == [x[:3] for x in b] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b, strict=True))
    assert close(search(), sorted(want))
    made = []
    keep = bm25.keep_best
    monkeypatch.setattr(bm25, "keep_best", lambda scores, ties, row, *rest: (made.append(len(row)), keep(scores, ties, row, *rest))[1])
    block = type("B", (), {"value": (np.arange(2), np.array([0, 2, 3]), np.array([0, 1, 1]), np.ones(3), np.array([0, 0, 1]))})
    rows = [(d, n, 1.0 + d % 7) for d in range(50) for n in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[a : a + 33], strict=True)], names=["doc_id", "no", "weight"]) for a in range(0, 100, 33)]
    monkeypatch.setattr(bm25, "TILE", 12)
    got = [r for b in bm25._scorer(block, 3)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(0, 6, 7.0, 0), (0, 13, 7.0, 0), (0, 20, 7.0, 0), (1, 6, 14.0, 0), (1, 13, 14.0, 0), (1, 20, 14.0, 0)] and max(made) <= 12
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 7)
    assert close(search(), sorted(want))


def test_texts_that_stay_the_same_are_not_sent_to_python(spark):
    """No code point that composition changes or joins is outside the ranges, so what isn't sent is its own NFC."""
    import re

    may, risky = re.compile(udf.COMPOSED), {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        x = chr(c)
        if unicodedata.normalize("NFC", x) != x or unicodedata.combining(x):
            risky.add(x)
        elif len(parts := unicodedata.decomposition(x).split()) == 2 and parts[0][0] != "<":
            risky.add(chr(int(parts[1], 16)))
    assert all(x > "˿" and may.match(x) for x in risky)
    texts = ["plain", "Größe", "été", "doanh nghiệp", "doanh nghiệp".encode().decode("latin1"), "", None, "각", "Ärger"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    sent = [r[0] for r in rows.select(udf.may_compose(c)).collect()]
    assert sent == [False, False, True, False, False, False, None, True, False]
    assert [r[0] for r in rows.select(T.nfc(c)).collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert [r[0] for r in rows.select(udf.mended(c)).collect()] == [udf.composed(udf.repair(t)) for t in texts]


def test_plain_texts_are_not_worked_on(spark):
    """Texts that are clean, or fit one span with plain ends, take the short way; the others' results are as before."""
    import itertools
    import re

    texts = ["".join(p) for p in itertools.product(["a", " ", "\n", "\t", "\u00a0", "\r", "\u3000"], repeat=4)] + ["", None, "a b\nc\n\nd", "x\x1f", "\u0085x"]

    def plain(t):
        t = unicodedata.normalize("NFC", t or "").translate({0xFEFF: " ", 0xA0: " "}).replace("\r\n", "\n").replace("\r", "\n")
        for pattern, new in (("[ \t]+", " "), ("\n[ \t]+|[ \t]+(?=\n)", "\n"), ("\n[ \t]+", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n")):
            t = re.sub(pattern, new, t)
        return t.strip(" \n\t\u3000\u0085")

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", T.clean_text(F.col("t")).alias("c"), udf.split_long(F.col("t"), ChunkConfig(3, 1, 1)).alias("s"), F.col("t").alias("t")).orderBy("i").collect()
    assert [r["c"] for r in got] == [plain(t) for t in texts]
    assert [r["s"] and [tuple(x) for x in r["s"]] for r in got] == [[] if t == "" else t and udf.long_spans(t, ChunkConfig(3, 1, 1)) for t in texts]


def test_sets_are_compared_once(spark):
    sets = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "p array<string>, g array<string>")
    scored = sets.select(metrics.set_scores(F.col("p"), F.col("g")).alias("s"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and plan.count("array_distinct") == 2
    assert [tuple(r["s"]) for r in scored.collect()] == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_contexts_shuffle_no_texts(spark):
    """The texts of what was found are joined with a small table, so they stay where they are."""
    from corpusloom.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the texts have
    try:
        plan = catalog.queries()["rendered_contexts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
