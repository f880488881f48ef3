import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.sources import html, readers, sinks
from eventloom.streaming import chains as stream
from tests.conftest import SF, rows


def test_json_caches(spark, tmp_path):
    for name, text in (("acme", '[{"event_type": "x", "confidence": 0.5, "extra": 1}, {"event_type": "y"}]'), ("empty", "[]"), ("bad", "{not json"), ("object", '{"a": 1}')):
        (tmp_path / f"{name}.json").write_text(text)
    found = readers.json_caches(spark, f"{tmp_path}/*.json", "event_type string, confidence double")
    assert rows(found, "slug", "status", "ordinal", "claim.event_type") == [("acme", "ok", 0, "x"), ("acme", "ok", 1, "y"), ("bad", "bad", None, None), ("empty", "empty", None, None), ("object", "bad", None, None)]
    assert json.loads(found.filter("ordinal = 0").first().raw)["extra"] == 1


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "ok.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1, 2\n')
    assert rows(readers.jsonl(spark, f"{tmp_path}/ok.jsonl", schema)) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        readers.jsonl(spark, f"{tmp_path}/bad.jsonl", schema).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    assert rows(readers.csv(spark, f"{tmp_path}/*.csv")) == [("1", 'two\nlines, "quoted"'), ("2", "")]


def test_documents(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "candidate_card.md").write_text("# one\nline")
    docs = readers.documents(spark, f"{tmp_path}/*/candidate_card.md")
    wanted = spark.createDataFrame([("c1",), ("c2",)], "card_id string")
    assert rows(readers.with_documents(wanted, docs), "card_id", "text", "missing") == [("c1", "# one\nline", False), ("c2", None, True)]


def test_files_and_sources(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    files = readers.by_file(spark, f"{tmp_path}/t")
    assert readers.first_rows(files, 2).count() == 2
    found = readers.per_source(spark, {"a": (f"{tmp_path}/t", True), "b": (f"{tmp_path}/none", False)})
    assert rows(found.groupBy("_source").count()) == [("a", 5)]
    with pytest.raises(FileNotFoundError):
        readers.per_source(spark, {"b": (f"{tmp_path}/none", True)})
    assert readers.parquet(spark, f"{tmp_path}/t", ["id", "more"], {"more": "string"}).columns == ["id", "more"]


CONTRACT = {
    "schema_version": "v1",
    "metadata": {"schema_version": "v1"},
    "event_types": ["x"],
    "event_type_definitions": {"x": "…"},
    "fields": [{"name": "id", "type": "large_string", "nullable": False}, {"name": "n", "type": "int64", "nullable": True}, {"name": "tags", "type": "list<element: large_string>", "nullable": True}],
}


def test_contract(spark):
    schema, kinds = readers.contract(json.dumps(CONTRACT))
    assert [f.dataType.simpleString() for f in schema] == ["string", "bigint", "array<string>"] and kinds == ("x",)
    df = sinks.to_contract(spark.createDataFrame([(1, "5")], "id int, n string"), schema)
    assert rows(df) == [("1", 5, None)]
    with pytest.raises(ValueError):
        sinks.to_contract(spark.range(1).select(F.col("id").alias("n")), schema)
    for change in ({"schema_version": "v2"}, {"event_types": ["x", "y"]}, {"fields": [{"name": "a", "type": "decimal"}]}):
        with pytest.raises(ValueError):
            readers.contract(json.dumps(CONTRACT | change))


def test_publish(spark, tmp_path):
    where = f"{tmp_path}/out"
    one = sinks.publish(spark, {"a": spark.range(3), "b": spark.range(2)}, where)
    assert one["a"]["rows"] == 3 and spark.read.parquet(f"{where}/b").count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"a": spark.range(4)}, where)
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        sinks.publish(spark, {"a": broken}, where, force=True)
    assert spark.read.parquet(f"{where}/a").count() == 3
    two = sinks.publish(spark, {"a": spark.range(3).repartition(3)}, where, force=True)
    assert two["a"]["sha256"] == one["a"]["sha256"]


def test_publish_checks_rows_inputs_and_more(spark, tmp_path, monkeypatch):
    where = f"{tmp_path}/out"
    seen = []
    inputs = {"in": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")}
    made = sinks.publish(spark, {"a": spark.range(3)}, where, inputs=inputs, code=sinks.code_state(sinks), validate=lambda t: seen.append(t["a"].count()))
    assert seen == [3] and made["code"]["code"].keys() == {"eventloom.sources.sinks"} and made["inputs"]["in"]["columns"] == ["a", "b"]
    manifest, tables = sinks.load_published(spark, where)
    assert manifest == made and tables["a"].count() == 3
    sinks.check_inputs(manifest, inputs)
    with pytest.raises(ValueError):
        sinks.check_inputs(manifest, {"in": inputs["in"].filter("a = 1")})

    def refuse(tables):
        raise ValueError("not these")

    with pytest.raises(ValueError):
        sinks.publish(spark, {"a": spark.range(9)}, where, force=True, validate=refuse)
    assert spark.read.parquet(f"{where}/a").count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{where}/a")
    with pytest.raises(ValueError):
        sinks.load_published(spark, where)


def test_texts_and_reports(spark, tmp_path):
    where = f"{tmp_path}/report.md"
    sinks.write_text(spark, where, sinks.markdown("Report", {"rows": spark.createDataFrame([(1, "a|b"), (2, None)], "k int, t string"), "many": spark.range(5)}, most=3))
    text = (tmp_path / "report.md").read_text()
    assert text.startswith("# Report\n\n## rows\n\n| k | t |\n| --- | --- |\n") and "a\\|b" in text and "3 of 5 rows" in text
    with pytest.raises(FileExistsError):
        sinks.write_text(spark, where, "x")
    sinks.write_text(spark, where, "ä", force=True)
    assert (tmp_path / "report.md").read_text() == "ä" and not [p for p in tmp_path.iterdir() if p.name.startswith("report.md.")]


def test_csv_jsonl_and_new_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', None)], "k int, t string, z string")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/c", ["t", "k"])
    assert spark.read.text(f"{tmp_path}/c/*.csv").count() == 2
    sinks.write_jsonl(df.coalesce(1).select("t", "z", "k"), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"k":1,"t":"a \\"b\\"","z":null}'
    sinks.write_new(df, f"{tmp_path}/p")
    with pytest.raises(Exception):
        sinks.write_new(df, f"{tmp_path}/p")
    sinks.write_new(df, f"{tmp_path}/p", force=True)
    empty = sinks.to_contract(df.limit(0), T.StructType([T.StructField("k", T.LongType()), T.StructField("q", T.DoubleType())]))
    sinks.write_new(empty, f"{tmp_path}/e")
    assert [f.dataType.simpleString() for f in spark.read.parquet(f"{tmp_path}/e").schema] == ["bigint", "double"]
    assert sinks.inferred(df, {"k": "double"}).schema["k"].dataType == T.DoubleType()
    with pytest.raises(ValueError):
        sinks.inferred(df.limit(0), {})


def test_configurations(spark, tmp_path):
    text = json.dumps({"entries": [{"canonical": "Acme", "aliases": ["ACME  Co", "acme"]}, {"canonical": "Beta"}], "firms": [{"slug": "a", "n": 1}]})
    assert rows(readers.aliases(spark, text)) == [("ACME  Co", "Acme"), ("Acme", "Acme"), ("Beta", "Beta"), ("acme", "Acme")]
    with pytest.raises(ValueError):
        readers.aliases(spark, json.dumps({"entries": [{"canonical": "A", "aliases": ["x"]}, {"canonical": "B", "aliases": [" X "]}]}))
    assert readers.firm(text, "a") == {"slug": "a", "n": 1}
    with pytest.raises(LookupError):
        readers.firm(text, "b")
    with pytest.raises(ValueError):
        readers.mapping("[1]")
    page = {"selectors": {"entry_selector": "li", "fields": {}}}
    assert readers.selectors(json.dumps(page)) == page
    with pytest.raises(ValueError):
        readers.selectors(json.dumps({"selectors": {"fields": {}}}))


def test_caches_meet_companies(spark):
    claims = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)], "slug string, n int")
    companies = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B2")], "slug string, name string")
    known, unmatched = readers.with_match(claims, companies)
    assert rows(known, "slug", "n") == [("a", 1), ("a", 2), ("b", 3)] and rows(unmatched) == [("c", 2)]


def test_newest_and_footer(spark, tmp_path):
    files = spark.createDataFrame([("a", "2024-01-02", 1), ("a", "2024-01-02", 2), ("a", "2023-12-31", 9), ("b", "2020-01-01", 3)], "slug string, day string, n int")
    assert rows(readers.newest(files, "slug", "day", "n")) == [("a", "2024-01-02", 2), ("b", "2020-01-01", 3)]
    spark.range(7).write.parquet(f"{tmp_path}/t")
    assert readers.footer(spark, f"{tmp_path}/t") == (7, ["id"])


def test_search_results(spark):
    df = spark.createDataFrame([("Acme", "about ACME", "u1", 1), ("Acme", "about acme again", "u1", 0), ("Acme", "about others", "u2", 2)], "name string, text string, url string, ordinal int")
    assert rows(readers.results_about(df, "name", "text", "url"), "url", "ordinal") == [("u1", 0)]
    fenced = spark.createDataFrame([("```json\n[1]\n```",), ("[1]",)], "t string").select(readers.fenced_json(F.col("t")))
    assert [r[0].strip() for r in fenced.collect()] == ["[1]", "[1]"]


def test_slug_overwrite(spark, tmp_path):
    where = f"{tmp_path}/cache"
    sinks.overwrite_slugs(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int"), where)
    sinks.overwrite_slugs(spark.createDataFrame([("b", 3)], "slug string, v int"), where)
    assert rows(spark.read.parquet(where), "slug", "v") == [("a", 1), ("b", 3)]


def test_searched_and_empty_slugs_are_kept(spark, tmp_path):
    where = f"{tmp_path}/cache"
    sinks.overwrite_slugs(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int"), where)
    sinks.overwrite_slugs(spark.createDataFrame([("a", 3)], "slug string, v int"), where, searched=spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"))
    found, searched = sinks.cached(spark, where)
    assert rows(found, "slug", "v") == [("a", 3)] and rows(searched) == [("a",), ("b",), ("c",)]


PAGE = '<nav><ul class="x y"><li><a href="/a">A &amp; B</a><li><a href="">C</a></ul></nav><div id="d"><img src="l.png"><p>t</p></div>'


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>")], "page_id int, html string")
    found = html.extract(pages, "page_id", "html", "ul.x a", {"name": ("", "text"), "href": ("", "href")})
    assert rows(found) == [(1, 0, "A & B", "/a"), (1, 1, "C", None)]
    assert rows(html.extract(pages, "page_id", "html", "#d", {"logo": ("img", "src")})) == [(1, 0, "l.png")]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from eventloom.plans import analogues

    events = analogues.events(spark, SF).select("event_id", "company_id", "event_type", "family", "day")
    half = F.col("event_id").cast("long") % 2 == 0
    store, out = f"{tmp_path}/store", f"{tmp_path}/chains"
    stream.update(events.filter(half), store, out)
    stream.update(events, store, out)  # the first half comes again
    stream.update(events.limit(0), store, out)
    made = rows(spark.read.parquet(out), "company_id", "chain_sequence", "end", "n_middle")
    from eventloom.plans import catalog

    want = catalog.queries()["chain_windows"](spark, SF).select("company_id", "chain_sequence", "end", (F.col("n_exposure") + F.col("n_interface")).alias("n"))
    assert made == rows(want)


def test_structured_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.read.parquet(f"{SF}/events.parquet").limit(500).selectExpr("cast(event_id as string) event_id", "user_id company_id", "event_type", "if(event_type = 'purchase', 'outcome', 'exposure') family", "to_date(ts) day").write.parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    stream.start(live, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/store").count() == 500
