"""Checkers from tables, the command line, and streams of revisions."""

import json

import pytest

from prosewright import __main__ as cli
from prosewright import engine
from prosewright.sources import artifacts
from prosewright.streaming import incremental

GRAMMAR = """<rules><category><rule id="OF"><pattern><token>should</token><token>of</token></pattern><message>Use <suggestion>should have</suggestion>.</message>
<example correction="should have">You <marker>should of</marker> gone.</example><example>You should go.</example></rule>
<rule id="TWO"><regexp>(teh)</regexp><message>m <suggestion>the</suggestion></message></rule></category></rules>"""


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("tables")
    (folder / "grammar.xml").write_text(GRAMMAR)
    (folder / "lex.tsv").write_text("you\tyou\tPRP\nshould\tshould\tMD\nof\tof\tIN\ngo\tgo\tVB\ngone\tgo\tVBN\nthere\tthere\tRB\ntheir\ttheir\tPRP$\nis\tbe\tVBZ\n")
    (folder / "sets.txt").write_text("their; there; 10\n")
    (folder / "uni.txt").write_text("there\t100\ntheir\t100\n")
    (folder / "bi.txt").write_text("there is\t9000\ntheir is\t1\nthere are\t3\nfoo bar\t5\n")
    out = f"{folder}/out"
    assert cli.main(["build-lexicon", f"{folder}/lex.tsv", "--out", out], spark) == 0
    assert cli.main(["convert", f"{folder}/grammar.xml", "--out", out], spark) == 0
    assert cli.main(["build-confusion", f"{folder}/sets.txt", f"{folder}/uni.txt", f"{folder}/bi.txt", "--tables", out], spark) == 0
    return out


def test_check_prints_all_layers(spark, tables, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("You should of gone.\nteh their is xyzzy")
    assert cli.main(["check", f"{tmp_path}/a.txt", "--tables", tables, "--layers", "spelling,grammar,confusion"], spark) == 0
    lines = [x.split("/a.txt:")[1] for x in capsys.readouterr().out.splitlines()]
    assert lines == ['1:5 OF "should of" -> "should have"', '2:1 SPELL "teh"', '2:1 TWO "teh" -> "the"', '2:5 CONFUSION "their" -> "there"', '2:14 SPELL "xyzzy"']
    assert cli.main(["check", f"{tmp_path}/a.txt", "--tables", tables, "--json"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert [x["code"] for x in found] == ["OF", "SPELL", "TWO", "SPELL"] and found[0]["start"] == 4 and found[0]["suggestions"] == ["should have"]


def test_other_commands(spark, tables, tmp_path, capsys):
    out = lambda *args: (cli.main(list(args), spark), capsys.readouterr().out)[1]
    assert json.loads(out("tokens", "You go.", "--tables", tables).splitlines()[0])["tags"] == ["SENT_START"]
    xml = tables.replace("/out", "/grammar.xml")
    assert out("score", xml, "--tables", tables) == "reproduced 1/1 (100.0%); false positives 0/1 (0.0%)\n"
    (tmp_path / "a.txt").write_text("You should of gone. You should of.")
    assert json.loads(out("audit", f"{tmp_path}/a.txt", "--tables", tables).splitlines()[0]) == {"code": "OF", "sentences": 2, "sample": json.loads(out("audit", f"{tmp_path}/a.txt", "--tables", tables).splitlines()[0])["sample"], "rate": 1.0, "anomaly": True}
    assert json.loads(out("inspect", "--tables", tables).splitlines()[0])["surfaces"] == 8
    first = out("manifest", f"{tmp_path}/a.txt")
    (tmp_path / "m.json").write_text(first)
    assert out("manifest", f"{tmp_path}/a.txt", "--against", f"{tmp_path}/m.json") == ""
    (tmp_path / "a.txt").write_text("x")
    assert json.loads(out("manifest", f"{tmp_path}/a.txt", "--against", f"{tmp_path}/m.json"))["status"] == "CHANGED"
    assert "cascade_all" in out("list")


def test_engine_knows_words(spark, tables):
    built = engine.build(spark, tables, ())
    words = spark.createDataFrame([("en", "You"), ("en", "nope"), ("de", "you")], "lang string, word string")
    assert [tuple(r) for r in built.engine.known(words).collect()] == [("en", "You")]
    assert built.check(spark.createDataFrame([(1, "en", "x")], "doc_id bigint, lang string, text string")).count() == 0


def test_pool_is_bounded():
    made = []
    pool = engine.Pool(lambda k: made.append(k) or k, most=2)
    assert [pool.get(k) for k in "abacab"] == list("abacab") and made == ["a", "b", "c", "b"]


def test_streams_of_revisions(spark, tables, tmp_path):
    rows = [(1, "en", 2, "r2", "You should of"), (1, "en", 1, "r1", "nope"), (2, "en", 5, "r3", "there")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "lang", "revision", "req_id", "text"), r))) for r in rows))
    stream = lambda: incremental.latest_stream(incremental.revisions(spark, f"{tmp_path}/in"))
    out, seen = [], []

    def run():
        query = stream().writeStream.foreachBatch(lambda batch, _: out.extend(r.req_id for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted(out))
        out.clear()

    run()
    # a late, older revision is dropped; a newer one comes through
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps({"doc_id": 2, "lang": "en", "revision": n, "req_id": f"x{n}", "text": "t"}) for n in (4, 6)))
    run()
    assert seen == [["r2", "r3"], ["x6"]]
    pool = engine.Pool(lambda lang: engine.build(spark, tables, ("spelling", "grammar")))
    query = incremental.check_stream(incremental.revisions(spark, f"{tmp_path}/in"), pool.get, f"{tmp_path}/sink", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/sink").collect()
    assert {(r.doc_id, r.req_id, r.code) for r in found} == {(1, "r2", "OF")}


def test_sweep_goes_on_where_it_was(spark, tmp_path):
    work = spark.range(10).withColumnRenamed("id", "key")
    record = f"{tmp_path}/done"
    work.filter("key < 4").write.parquet(record)
    assert incremental.sweep(work, "key", record, lambda part: part, size=4) == 2
    assert sorted(r.key for r in spark.read.parquet(record).collect()) == list(range(10))


def test_labels_and_meta():
    assert artifacts.label_list('["$KEEP", "$DELETE"]') == artifacts.label_list('{"$DELETE": 1, "$KEEP": 0}') == ["$KEEP", "$DELETE"]
    assert artifacts.tagger_meta('{"least": 0.5, "passes": null}') == {"keep_bias": 0.2, "least": 0.5, "passes": 5}
