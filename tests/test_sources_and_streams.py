import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import answers, relational
from lexloom.sources import batches, files, rest
from lexloom.streaming.incremental import append_new, landed_answers


def test_file_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, None)], "k int, t string")
    files.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", "k int, t string").collect())) == [(1, 'two\nlines, "quoted"'), (2, None)]
    files.write_jsonl(rows, f"{tmp_path}/jsonl")
    files.write_jsonl(rows, f"{tmp_path}/jsonl")
    assert files.read_jsonl(spark, f"{tmp_path}/jsonl", "k int, t string").count() == 4
    assert files.read_jsonl(spark, f"{tmp_path}/none", "k int").count() == 0
    (tmp_path / "map.json").write_text('{"5.0": "7", "": "3", "8": null}')
    assert [tuple(r) for r in files.read_mapping(spark, f"{tmp_path}/map.json").collect()] == [("5", "7")]
    assert files.read_mapping(spark, f"{tmp_path}/none.json").count() == 0


def test_cases_and_stage(spark, tmp_path):
    cols = "court_name string, name string, docket_number string, opinion_type string"
    data = [("U.S. Court of Appeals, Third Circuit", "a", "d1", "dissent"), ("Third Circuit Appeals", "b", "d1", "Majority"), ("D. Delaware", "c", "d1", "x"), ("D. Maine", "d", "d2", "x")]
    spark.createDataFrame(data, cols).coalesce(1).write.parquet(f"{tmp_path}/lake")
    got = files.read_cases(spark, f"{tmp_path}/lake", "3rd").collect()
    assert sorted((r.name, r.is_appellate) for r in got) == [("b", 1), ("c", 0)]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert files.stage(spark, f"{tmp_path}/st", make).count() == files.stage(spark, f"{tmp_path}/st", make).count() == 3 and len(made) == 1
    with pytest.raises(ValueError, match="zz"):
        relational.require_columns(spark.range(1), ["id", "zz"])


def test_packing(spark):
    sized = spark.createDataFrame(list(enumerate([60, 50, 40, 120, 10])), "ord long, n_bytes long")
    assert [r.part for r in relational.pack_by_bytes(sized, 100).orderBy("ord").collect()] == [1, 2, 2, 3, 4]


def test_answers(spark):
    good = {"custom_id": "CAP_1", "error": None, "response": {"body": {"choices": [{"message": {"content": '{"opinion": "affirmed", "politicality_score": 3, "lower_judge_first": "Ann", "lower_judge_last": "Lee"}'}}]}}}
    bad = {"custom_id": "2", "response": {"body": {"choices": [{"message": {"content": "[1]"}}]}}}
    lines = [json.dumps(good), "", "{", json.dumps({"error": {"code": 1}}), json.dumps(bad), json.dumps({"custom_id": "3"})]
    decoded = answers.decode_answers(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.custom_id, r.opinion, r.politicality_score) for r in decoded.collect()] == [("CAP_1", "affirmed", 3)]
    cases = spark.createDataFrame([("1", 0, "x v. y", "t", "d", 9, "Lee"), ("7", 1, "z", "t", "d", 5, "Roe")], "unique_id string, ord int, name string, opinion_text string, docket_number string, opinion_author_id int, opinion_author_clean string")
    mapping = spark.createDataFrame([("1", "7")], "appellate_uid string, district_uid string")
    linked = answers.attach_to_linked(cases, mapping, decoded).first()
    assert (linked.unique_id, linked.district_judge_id, linked.opinion) == ("CAP_1", 5, "affirmed")
    judges = spark.createDataFrame([(1, 0, "Ann", "Lee"), (9, 1, "ann", "LEE")], "judge_id int, ord int, first_name string, last_name string")
    opinions = spark.createDataFrame([("CAP_1", "n", "t", "d")], "unique_id string, name string, opinion_text string, docket_number string")
    got = answers.attach_to_opinions(opinions, decoded, judges).first()
    assert (got.district_judge, got.district_judge_id) == ("lee", 1)


def test_backfill(spark):
    cap = spark.createDataFrame([(0, "d1", None, None), (1, "d2", 5, "x")], "ord int, docket_number string, i int, n string")
    cl = spark.createDataFrame([(0, "d1", None, "n1"), (1, "d1", 7, "n2"), (2, "d3", 9, "z"), (3, None, 1, "q")], "ord int, docket_number string, i int, n string")
    cl = cl.unionByName(spark.createDataFrame([(0, " d1 ", None, "n0"), (1, "d1", 3, None)], "ord int, docket_number string, i int, n string"))  # ties of ord
    got = relational.backfill_merge(cap, cl, "docket_number", ["i", "n"]).collect()
    assert sorted((str(r.docket_number), r.i, r.n) for r in got) == [("None", 1, "q"), ("d1", 3, "n0"), ("d2", 5, "x"), ("d3", 9, "z")]


PAGES = {
    "http://x/search/": {"results": [{"cluster_id": 1, "caseName": " A v. B ", "docketNumber": "1-2", "dateFiled": "2001-01-01"}, {"cluster": "http://x/clusters/2/"}, {"caseName": "none"}], "next": "http://x/p2"},
    "http://x/p2": {"results": [{"cluster_id": 1}, {"cluster_id": 3}], "next": None},
    "http://x/clusters/1/": {"plain_text": "text one"},
    "http://x/clusters/2/": {"sub_opinions": ["http://x/o/2"], "docket": "http://x/d/2"},
    "http://x/o/2": {"html": "<p>two</p><script>x</script>"},
    "http://x/d/2": {"docket_number_core": "77"},
    "http://x/clusters/3/": {},
}


def replay(options):
    return lambda url, params: (200, {}, PAGES[url])


def test_rest_source(spark):
    spark.dataSource.register(rest.OpinionRestSource)
    read = spark.read.format("opinion_rest").option("base", "http://x").option("circuits", "3rd").option("transport", "tests.test_sources_and_streams:replay")
    assert sorted(map(tuple, read.load().collect())) == [("3rd", "1", "A v. B", "1-2", "2001-01-01", "text one"), ("3rd", "2", "", "77", "", "two")]
    assert read.option("limit", "1").load().count() == 1


def test_retries():
    waits, calls = [], []

    def flaky(url, params):
        calls.append(params)
        return (503, {"Retry-After": "2"}, None) if len(calls) < 3 else (200, {}, {"ok": 1})

    assert rest.Client(flaky, waits.append).get("u", {"a": 1}) == {"ok": 1} and calls == [{"a": 1}] * 3 and waits[0] == 2.0
    with pytest.raises(RuntimeError, match="gave up"):
        rest.Client(lambda u, p: (500, {}, None), lambda s: None, attempts=2).get("u")


def test_only_new_rows_are_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\nx\n")
    run = lambda: append_new(landed_answers(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", "value").awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("y\nz\n")
    run()
    run()
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("value")).collect()) == ["x", "y", "z"]


def test_batches(spark, tmp_path):
    class Fake:
        states = [{"status": "running"}, {"status": "completed", "output_file_id": "f"}]

        def status(self, bid):
            return self.states.pop(0) if len(self.states) > 1 else self.states[0]

        def download(self, fid, path):
            (tmp_path / "results").mkdir(exist_ok=True)
            open(path, "w").write(fid)

        def upload(self, path):
            return "up"

        def create(self, fid, endpoint, window):
            return f"b-{fid}"

    client = Fake()
    assert batches.enqueue(client, ["p"]) == ["b-up"]
    assert batches.download_new(spark, client, ["b1"], str(tmp_path), poll=True, sleep=lambda s: None) == [f"{tmp_path}/results/b1.jsonl"]
    assert batches.download_new(spark, client, ["b1"], str(tmp_path)) == []


def test_ingest_goes_on_where_it_was(spark, tmp_path):
    spark.dataSource.register(rest.OpinionRestSource)
    options = {"base": "http://x", "transport": "tests.test_sources_and_streams:replay"}
    at = f"{tmp_path}/opinions"
    assert rest.ingest(spark, at, ["3rd"], options, limit=1) == 1
    assert rest.ingest(spark, at, ["3rd"], options, every=1) == 1
    assert rest.ingest(spark, at, ["3rd"], options) == 0
    assert sorted(r["_cid"] for r in spark.read.parquet(at).collect()) == ["1", "2"]


def test_part_files_and_mapping(spark, tmp_path):
    lines = ["a" * 59, "b" * 49, "ü" * 19, "c" * 300, "d"]
    files.write_parts(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"), f"{tmp_path}/parts", 100)
    got = {p.name: [f.read_text() for f in p.glob("part-*")] for p in (tmp_path / "parts").glob("part=*")}
    assert got == {"part=1": ["a" * 59 + "\n"], "part=2": ["b" * 49 + "\n" + "ü" * 19 + "\n"], "part=3": ["c" * 300 + "\n"], "part=4": ["d\n"]}
    links = spark.createDataFrame([("7", "1"), ('q"ü', "2"), ("7", "1"), ("8", None)], "appellate_uid string, district_uid string")
    files.write_mapping(links, f"{tmp_path}/map")
    assert json.loads("".join(f.read_text() for f in (tmp_path / "map").glob("part-*"))) == {"7": "1", 'q"ü': "2"}
    assert sorted(map(tuple, files.read_mapping(spark, f"{tmp_path}/map").collect())) == [("7", "1"), ('q"ü', "2")]
    files.write_mapping(links.limit(0), f"{tmp_path}/none")
    assert files.read_mapping(spark, f"{tmp_path}/none").collect() == []


def test_saved_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text('_cid,text\n5,"two\nlines"\n5,x\n,y\n')
    (tmp_path / "a.jsonl").write_text('{"unique_id": 3}\n\n{"unique_id": "x"}\n{}\n')
    assert [r["_cid"] for r in files.saved_ids(spark, f"{tmp_path}/a.csv", "_cid").collect()] == ["5"]
    assert sorted(r.unique_id for r in files.saved_ids(spark, f"{tmp_path}/a.jsonl", "unique_id").collect()) == ["3", "x"]
    assert files.saved_ids(spark, f"{tmp_path}/none.csv", "k").collect() == []


def test_several_circuits_from_one_scan(spark, tmp_path):
    rows = [("D. Delaware", "a", "d1", "x"), ("D. Maine", "b", "d2", "x"), ("W.D. Arkansas", "c", "d3", "x"), ("Eighth Circuit Court of Appeals", "d", "d1", "x"), ("Third Circuit Court of Appeals", "e", "d1", "x"), (None, "f", "d9", "x")]
    spark.createDataFrame(rows, "court_name string, name string, docket_number string, opinion_type string").write.parquet(f"{tmp_path}/lake")
    got = files.read_cases(spark, f"{tmp_path}/lake", ["3rd", "8th", "10th"]).collect()
    assert sorted((r.circuit, r.name) for r in got) == [("10th", "c"), ("3rd", "a"), ("3rd", "e"), ("8th", "c"), ("8th", "d")]  # "Kansas" is in "Arkansas"
    alone = sorted((c, r.name) for c in ("3rd", "8th", "10th") for r in files.read_cases(spark, f"{tmp_path}/lake", c).collect())
    assert alone == sorted((r.circuit, r.name) for r in got)
    assert len(files.read_cases(spark, f"{tmp_path}/lake").collect()) == 5  # the two appeals share a docket


class Letters:
    def encode(self, text):
        return list(text)

    def decode(self, ids):
        return "".join(ids)


def test_texts_by_a_tokenizer(spark):
    cases = spark.createDataFrame([(3, 3, 1, "abcdefg"), (1, 1, 1, None), (2, 2, 0, "no"), (9, 0, 1, "héé"), (5, 5, 1, "abcd")], "unique_id long, ord long, is_appellate int, opinion_text string")
    assert sorted(map(tuple, answers.build_texts(cases, 3, make=Letters).collect())) == [("1", ""), ("3", "abcefg"), ("5", "abcbcd"), ("9", "héé")]
    assert sorted(r.custom_id for r in answers.build_texts(cases, 3, limit=2).collect()) == ["1", "9"]


def test_counted(spark):
    rows, seen = relational.counted(spark.range(7), "n")
    assert rows.where("id > 3").count() == 3 and seen.get == {"n": 7}


def test_prefixes_of_an_empty_table(spark):
    assert tuple(relational.any_with_prefix(spark.range(0), "id", "CL_", "CAP_").first()) == (False, False)
