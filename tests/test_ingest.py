"""Sources, full texts, the table store, rate limiting and streaming."""

import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import Corpus
from quire.operators import ratelimit
from quire.plans import ingest
from quire.sources import evalsets, fulltext, papers as sources
from quire.sources.store import TableStore
from quire.streaming.enrich import enrich_stream, read_entities
from quire.streaming.ratelimit import admit_stream


@pytest.fixture(scope="module")
def publications(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pub") / "p.parquet")
    rows = [
        ("P18-1", "A", " text a ", "X Y and Z", 2018, "ACL", "full", "u"),
        ("2022.emnlp-main.2", "B", "text b", "X Y, Z", 2022, None, " ", None),
        ("D19-3", None, "text c", "", 2019, None, None, None),
        ("D19-4", "D", "  ", "", 2019, None, None, None),
        ("X1", "E", "text e", None, 2020, None, None, None),
    ]
    schema = "acl_id string, title string, abstract string, author string, year bigint, booktitle string, full_text string, url string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


def test_publications(spark, publications):
    source = sources.PublicationParquet(publications)
    rows = {r["source_id"]: r for r in source.load(spark).collect()}
    assert set(rows) == {"P18-1", "2022.emnlp-main.2", "X1"}
    first = rows["P18-1"]
    assert (first["id"], first["abstract"], first["venue"], first["authors"]) == ("hf_acl_ocl::P18-1", "text a", "acl", ["X Y", "Z"])
    second = rows["2022.emnlp-main.2"]
    assert (second["volume"], second["full_text"], second["authors"]) == ("main", None, ["X Y", "Z"])
    assert [r["source_id"] for r in source.load(spark, 2019, 2022, ["EMNLP"]).collect()] == ["2022.emnlp-main.2"]
    assert source.load(spark, max_papers=2).count() == 2
    with pytest.raises(FileNotFoundError):
        sources.PublicationParquet(publications + ".none").load(spark)


def test_anthology(spark, tmp_path):
    rows = [
        {"full_id": "2024.acl-long.1", "title": "T", "abstract": "a", "year": " 2024", "venue_ids": ["ACL"], "authors": [{"first": "A", "last": "B"}], "web_url": "w"},
        {"full_id": "b", "title": "T", "abstract": "a", "year": "n.d."},
        {"full_id": "c", "title": "T", "abstract": " ", "year": "2024"},
    ]
    path = tmp_path / "a.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    (row,) = sources.AnthologyExport(str(path)).load(spark, venues=["acl"], max_papers=5).collect()
    assert (row["id"], row["year"], row["volume"], row["url"], row["authors"]) == ("acl_anthology::2024.acl-long.1", 2024, "long", "w", ["A B"])


def test_fetch_and_pages(spark, papers):
    missing = fulltext.missing_full_text(papers)
    assert [r["id"] for r in missing.collect()] == ["s::P18-1001"]
    urls = spark.createDataFrame([("a::b/1", "big"), ("c", "small"), ("d", "bad")], "id string, url string")

    def transport(url):
        if url == "bad":
            raise OSError("gone")
        return b"page one\n\n\nline\fpage two " * 100 if url == "big" else b"x"

    got = {r["id"]: r for r in fulltext.fetch(urls, transport).collect()}
    assert got["a::b/1"]["error"] is None and got["a::b/1"]["file_name"] == "a_b_1"
    assert got["c"]["error"] == "only 1 bytes" and got["d"]["error"] == "gone"
    pages = fulltext.page_texts("content", lambda data: data.decode().split("\f"))
    text = fulltext.fetch(urls, transport).select("id", fulltext.text_of_pages(pages).alias("t")).collect()
    by_id = {r["id"]: r["t"] for r in text}
    assert by_id["a::b/1"].startswith("page one\n\nline\n\npage two page one") and by_id["c"] is None


def test_files_and_work_list(spark, tmp_path):
    (tmp_path / "a_1.pdf").write_bytes(b"data")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = fulltext.read_files(spark, str(tmp_path)).collect()
    assert [(r["file_name"], bytes(r["content"])) for r in rows] == [("a_1", b"data")]
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    todo = frame("a", "a", "b", "c")
    assert sorted(r[0] for r in fulltext.work_list(todo, frame("a"), frame("b")).collect()) == ["b", "c"]
    assert [r[0] for r in fulltext.work_list(todo, frame("a"), frame("b"), False).collect()] == ["c"]


def test_tei(spark):
    filler = "word " * 60
    tei = (
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><profileDesc><abstract><p>About <b>this</b></p></abstract></profileDesc>'
        f'</teiHeader><text><body><div><head n="1"> Intro <i>x</i></head><p>First</p><p/><p> </p><div><p>{filler}</p></div></div>'
        "<div><head>Second &amp; last</head><p>a<ref>b</ref>c</p></div></body></text></TEI>"
    )
    cases = [tei, tei.replace(filler, "x"), "<broken", None, "", tei + " junk", tei.replace("</ref>", "")]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    found = [r[1] for r in frame.select("k", fulltext.text_of_tei(F.col("t"))).orderBy("k").collect()]
    assert found[0] == f"About  this\n\n\nIntro\n\n\nFirst\n\n{filler.strip()}\n\n\nSecond & last\n\n\na b c"
    assert found[1:] == [None] * 6


def test_evaluation_files(spark, tmp_path):
    data = {"examples": [{"query": "q", "relevant_paper_ids": ["p"], "reference_answer": "r", "metadata": {"a": "b"}}]}
    (tmp_path / "smoke.json").write_text(json.dumps(data))
    row = evalsets.read_dataset(spark, str(tmp_path / "smoke.json")).first()
    assert (row["dataset"], row["query"], row["keywords"], row["metadata"]) == ("smoke", "q", [], {"a": "b"})
    entries = [
        {"id": "q001", "relevant_chunk_ids": ["1"], "pooled_from": {"bm25": ["1"]}, "generation_scores": {"faithfulness": True, "relevance": 4, "citation_accuracy": False}},
        {"id": "q002", "relevant_chunk_ids": []},
    ]
    (tmp_path / "set.json").write_text(json.dumps(entries, indent=1))
    path = str(tmp_path / "set.json")
    assert [r["id"] for r in evalsets.read_eval_set(spark, path).collect()] == ["q001"]
    assert evalsets.generation_scores(evalsets.read_eval_set(spark, path, False)).first()["relevance"] == 4


def test_corpus_tables(spark, publications, tmp_path):
    tables = TableStore(spark, str(tmp_path / "corpus"))
    assert not tables.complete()
    tables.create()
    tables.create()
    loaded = sources.PublicationParquet(publications).load(spark)
    again = loaded.unionByName(loaded)
    ingest.add_papers(tables, again)
    ingest.add_papers(tables, again)
    assert tables.read("papers").count() == 3 and tables.read("authors").count() == 4
    updates = spark.createDataFrame([("hf_acl_ocl::X1", "BERT " * 500)], "id string, full_text string")
    ingest.update_full_texts(tables, updates)
    ingest.rebuild_chunks(tables)
    chunk_ids = sorted(r["id"] for r in tables.read("chunks").collect())
    ingest.rebuild_chunks(tables)
    assert chunk_ids == sorted(r["id"] for r in tables.read("chunks").collect())
    assert len(set(chunk_ids)) == 4
    ingest.embed_chunks(tables, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    ingest.embed_chunks(tables, lambda texts: 1 / 0)
    assert tables.read("embeddings").count() == 4
    ingest.enrich_papers(tables, [("method", "text")])
    ingest.enrich_papers(tables, [("method", "text")])
    assert tables.read("entities").count() == 3
    index = str(tmp_path / "index")
    ingest.rebuild_index(tables, index)
    tables.copy_to(str(tmp_path / "snapshot"))
    assert TableStore(spark, str(tmp_path / "snapshot")).complete()
    corpus = Corpus.open(spark, str(tmp_path / "snapshot"), index)
    asked = spark.createDataFrame([(1, "bert", [1.0, 0.0])], "query_id int, query_text string, embedding array<float>")
    best = corpus.search(asked).orderBy("rank").first()
    assert best["paper_id"] == "hf_acl_ocl::X1" and best["title"] == "E"
    blocks = str(tmp_path / "blocks")
    ingest.rebuild_blocks(tables, blocks)
    ingest.open_blocks(tables, blocks)
    other = Corpus.open(spark, str(tmp_path / "snapshot"), blocks_path=blocks)
    year = best["year"]
    for bounds in ({}, {"year_min": year, "year_max": year}, {"year_min": year + 1}):
        ranked = [[(r["rank"], r["chunk_id"]) for r in c.search(asked, **bounds).orderBy("rank").collect()] for c in (corpus, other)]
        assert ranked[0] == ranked[1]


def test_vectors_and_index_follow_the_chunks(spark, tmp_path):
    """Papers are added and chunks rebuilt; no chunk gets the vector of another paper."""
    tables = TableStore(spark, str(tmp_path / "corpus"))
    tables.create()

    def load(first, last):
        rows = [(f"s::{k}", str(k), "s", f"T{k}", f"text {'x' * k}", [f"A{k}"], 2000 + k, "acl", None, None, None) for k in range(first, last)]
        ingest.add_papers(tables, spark.createDataFrame(rows, (
            "id string, source_id string, source string, title string, abstract string, authors array<string>, year int, "
            "venue string, volume string, full_text string, url string"
        )))
        ingest.rebuild_chunks(tables)

    def encode(texts):
        return np.array([[len(t), 1.0] for t in texts])

    load(0, 20)
    ingest.embed_chunks(tables, encode)
    index = str(tmp_path / "index")
    ingest.rebuild_index(tables, index)
    assert ingest.open_index(tables, index).analyzer == "letters"
    load(20, 40)
    with pytest.raises(ValueError, match="build it again"):
        ingest.open_index(tables, index)
    ingest.embed_chunks(tables, encode)
    ingest.update_full_texts(tables, spark.createDataFrame([("s::3", "another text")], "id string, full_text string"))
    ingest.rebuild_chunks(tables)
    ingest.embed_chunks(tables, encode)
    rows = tables.read("chunks").join(tables.read("embeddings").withColumnRenamed("chunk_id", "id").drop("paper_id", "chunk_type", "chunk_index"), "id").collect()
    assert len(rows) == 40 == tables.read("embeddings").count()
    for r in rows:
        size = len(r["chunk_text"])
        assert r["embedding"][0] / r["embedding"][1] == pytest.approx(size, rel=1e-3)


def test_first_duplicate_wins(spark, tmp_path):
    tables = TableStore(spark, str(tmp_path / "corpus"))
    tables.create()
    rows = [("s::1", "1", "s", t, "abstract", [a], 2000, "acl", None, None, None) for t, a in (("second name, first row", "Zoe"), ("a", "Ann"), ("b", "Bob"))]
    schema = (
        "id string, source_id string, source string, title string, abstract string, authors array<string>, year int, "
        "venue string, volume string, full_text string, url string"
    )
    ingest.add_papers(tables, spark.createDataFrame(rows, schema).coalesce(1))
    assert tables.read("papers").first()["title"] == "second name, first row"
    assert [r["name"] for r in tables.read("authors").collect()] == ["Zoe"]


def simulate(rows, limit, seconds):
    logs, out = {}, {}
    for client, request, at in sorted(rows, key=lambda r: (r[2], r[1])):
        log = logs.setdefault(client, deque())
        while log and log[0] <= at - seconds:
            log.popleft()
        if len(log) >= limit:
            out[request] = (False, int(seconds - (at - log[0])) + 1)
        else:
            log.append(at)
            out[request] = (True, None)
    return out


@pytest.fixture(scope="module")
def request_rows():
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(1500):
        # A third of all requests come from one client, in bursts.
        client = 0 if i % 3 == 0 else rng.randrange(1, 6)
        at += rng.choice([0] * 12 + [1, 1, 2, 30, 61])
        rows.append((client, i, at))
    return rows


def test_rate_limit(spark, request_rows):
    frame = spark.createDataFrame(request_rows, "client int, request_id int, s bigint").select(
        "client", "request_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")
    )
    for limit, seconds in ((10, 60), (2, 60), (1, 5)):
        got = {r["request_id"]: (r["admitted"], r["retry_after"]) for r in ratelimit.admissions(frame, limit, seconds).collect()}
        want = simulate(request_rows, limit, seconds)
        assert got == want
        assert any(not admitted for admitted, _ in want.values())


def test_segments_split_a_hot_client(spark, request_rows):
    frame = spark.createDataFrame(request_rows, "client int, request_id int, s bigint").withColumn("bucket", F.floor(F.col("s") / 60))
    cut = ratelimit.segments(frame, 10, 60).filter("client = 0")
    assert cut.select("segment").distinct().count() > 20


def test_client_of(spark):
    rows = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "3.3.3.3"), (None, "3.3.3.3"), ("", None)], "f string, a string")
    assert [r[0] for r in rows.select(ratelimit.client_of(F.col("f"), F.col("a"))).collect()] == ["1.1.1.1", "3.3.3.3", "unknown"]


def test_rate_limit_stream(spark, request_rows, tmp_path):
    rows = request_rows[:300]
    schema = "client int, request_id int, s bigint"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    timed = stream.select("client", "request_id", F.timestamp_seconds("s").alias("ts"))
    query = admit_stream(timed, 2, 60).writeStream.format("memory").queryName("admitted").outputMode("append")
    running = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = {r["request_id"]: (r["admitted"], r["retry_after"]) for r in spark.table("admitted").collect()}
    assert got == simulate(rows, 2, 60)


def test_stream_state_goes_when_clients_rest(spark, tmp_path):
    schema = "client int, request_id int, s bigint"
    state = str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        timed = stream.select("client", "request_id", F.timestamp_seconds("s").alias("ts"))
        query = admit_stream(timed, 2, 60, "0 seconds").writeStream.format("parquet").option("checkpointLocation", state)
        query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        logs = spark.read.format("statestore").option("path", state).option("stateVarName", "log").load()
        return sorted({r["key"]["client"] for r in logs.select("key").collect()})

    rows = [(c, 10 * c + k, 1000 + k) for c in range(20) for k in range(3)]
    assert run(rows) == list(range(20))
    assert run([(0, 900, 1030)]) == list(range(20))
    assert run([(0, 901, 1062), (7, 902, 1063)]) == [0, 7]  # the others rest for a window
    got = {r["request_id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    more = simulate([*rows, (0, 900, 1030), (0, 901, 1062), (7, 902, 1063)], 2, 60)
    assert got == {k: a for k, (a, _) in more.items()}


def test_enrich_stream(spark, papers, tmp_path):
    source = papers.select("id", "title", "abstract")
    source.limit(2).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        enrich_stream(stream, out, state, once=True).awaitTermination(120)

    run()
    source.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r["paper_id"], r["name"]) for r in read_entities(spark, out).collect()}
    assert ("s::P18-1001", "BERT") in got and ("t::2022.acl-long.100", "multilingual") in got
    assert read_entities(spark, out).count() == len(got)


def test_appended_entities_are_counted_and_sketched(spark, tmp_path):
    from quire.operators import counts, sketches
    from quire.plans import ingest

    store = TableStore(spark, str(tmp_path))
    store.create()
    schema = store.read("entities").schema

    def rows(first, last):
        made = [{"paper_id": f"p{i}", "entity_type": kind, "name": f"{kind}{i % m}"} for i in range(first, last) for kind, m in (("method", 700), ("task", 40))]
        return spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in made], schema)

    assert ingest.append_entities(store, rows(0, 3000)) == {"rows": 6000, "methods": 3000, "datasets": 0, "tasks": 3000, "topics": 0}
    assert ingest.append_entities(store, rows(2000, 4000))["rows"] == 4000
    kept = store.read(ingest.SKETCHES)
    assert {r["entity_type"]: r["rows"] for r in kept.collect()} == {"method": 5000, "task": 5000}
    assert ingest.entity_sketches(store).inputFiles() == kept.inputFiles()
    papers = spark.range(4000)
    exact = counts.enrichment_stats(papers, store.read("entities")).first().asDict()
    near = sketches.stats(kept, papers).first().asDict()
    assert set(near) == set(exact) and all(abs(near[k] - exact[k]) <= 0.02 * exact[k] for k in exact)
    # Rows that came another way make the sketches again.
    store.append("entities", rows(9000, 9010))
    again = {r["entity_type"]: r for r in sketches.estimates(ingest.entity_sketches(store)).collect()}
    assert again["method"]["rows"] == 5010 and abs(again["method"]["papers"] - 4010) < 80


def test_files_by_prefix(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(10)
    tables = TableStore(spark, root, {"a": rows.schema, "ab": rows.schema})
    assert tables.files().count() == 0
    tables.overwrite("a", rows.repartition(3))
    tables.overwrite("a", rows.repartition(2))
    tables.overwrite("ab", rows.coalesce(1))
    found = tables.files().collect()
    folders = sorted(r["path"].rsplit("/", 1)[0] for r in found)
    assert folders == ["a/v1"] * 3 + ["a/v2"] * 2 + ["ab/v1"] and all(r["length"] > 0 for r in found)
    assert tables.files("a/").count() == 5 and tables.files("a/v2/").count() == 2 and tables.files("b").count() == 0


def test_united_sketches_stay_within_two_percent(spark):
    """Ids that a sketch of 2**14 slots takes for 97,415."""
    from pyspark.sql import functions as F
    from quire.operators import sketches

    paper = F.concat(F.lit("orders::"), "id")
    rows = spark.range(9_400_000, 9_500_000).select(F.lit("task").alias("entity_type"), paper.alias("name"), paper.alias("paper_id"))
    late = F.pmod(F.xxhash64("paper_id"), F.lit(2)) == 1
    found = sketches.estimates(sketches.united(*[sketches.distinct_sketches(rows.filter(c)) for c in (~late, late)])).first()
    assert found["rows"] == 100_000 and all(abs(found[n] - 100_000) <= 2_000 for n in ("names", "papers"))
