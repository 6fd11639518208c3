import pytest

from pairforge import cli
from pairforge.cli import parse_free, timed
from pairforge.operators import chat as C
from pairforge.sources import sinks as SK
from pairforge.operators import metrics as M
from pairforge.operators import pairs as P
from pairforge.plans.metrics import overlap_score
from pairforge.sources import readers as R


def test_free_parameters():
    assert parse_free(["--a", "1", "--b=2.5", "--c", "true", "--d", "x"]) == {"a": 1, "b": 2.5, "c": True, "d": "x"}
    for bad in (["--a=1=2"], ["a"], ["--a"]):
        with pytest.raises(ValueError):
            parse_free(bad)


def test_a_run_from_file_to_measures(spark, tmp_path):
    (tmp_path / "s.csv").write_text("text_1,text_2,title_1,title_2,need_match\naa bb,aa bb,t,u,TRUE\naa bb,cc dd,t,u,FALSE\naa,aa zz,t,u, TRUE\n", encoding="utf-8")
    pairs = R.load_dataset(spark, "studentor_partner", f"{tmp_path}/s.csv")
    assert [r["need_match"] for r in pairs.orderBy("pair_id").collect()] == [True, False, False]
    row = M.evaluate(overlap_score(pairs), []).first()
    assert row["auc"] == 1 and row["f1"] == 1
    assert len(timed(pairs, overlap_score)) == 5
    assert P.profile(pairs).first()["unique_1"] == 2


def test_numbering_follows_files_and_rows(spark, tmp_path):
    """Whatever files the reader packs together, which it does by size."""
    first = 0
    for k, n in enumerate((10, 4000, 20000, 0, 3)):
        spark.range(first, first + n, 1, 1).write.parquet(f"{tmp_path}/t/part={k}")
        first += n
    df = spark.read.parquet(f"{tmp_path}/t")
    rows = R.number_rows(df, "n")
    assert rows.count() == first and rows.where("n <> id").count() == 0 and rows.select("n").distinct().count() == first
    assert R.number_rows(df.where("id < 0"), "n").count() == 0


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A data set, a benchmark, a corpus and a scenario."""
    folder = tmp_path_factory.mktemp("files")
    lines = ["text_1,text_2,title_1,title_2,need_match"] + [f"aa bb c{i},{'aa bb' if i % 2 else 'dd ee'} c{i},t,u,{'TRUE' if i % 2 else 'FALSE'}" for i in range(12)]
    (folder / "s.csv").write_text("\n".join(lines), encoding="utf-8")
    spark.createDataFrame([(["aa", "bb"],), (["dd", "ee"],)] * 30, "preprocessed_text array<string>").write.parquet(f"{folder}/c.parquet")
    spark.createDataFrame([("Aa bb, 12!",)], "text string").write.parquet(f"{folder}/raw.parquet")
    (folder / "k.csv").write_text("group,window,epochs,sg,min_count,vector_size\n1,2,1,1,1,4\n1,x,2,x,x,x\n", encoding="utf-8")
    return folder


def test_commands(spark, files, capsys):
    data = ["--dataset", "studentor_partner", "--path", f"{files}/s.csv"]
    pairs = ["--path", f"{files}/s.csv", "--text_1", "text_1", "--text_2", "text_2"]
    vectors, corpus = f"{files}/v.parquet", ["--corpus", f"{files}/c.parquet"]

    def run(*args):
        assert cli.main(list(args)) == 0
        return capsys.readouterr().out

    assert "kw_cutoff" in run("params", "--model", "keywords")
    assert float(run("match", "aa bb", "aa bb", "--model", "tfidf")) == pytest.approx(100)
    assert "unique_1" in run("profile", *data)
    assert "cutoff_auc" in run("evaluate", *data, "--model", "tfidf", "--low", "1")
    assert "compat_fp" in run("evaluate", *data, "--model", "sentences", "--cutoff", "0.5")
    assert "title_1" in run("scores", *data, "--model", "transformer")
    assert "precision" in run("curve", *data, "--model", "tfidf", "--kind", "pr")
    assert "sublinear" in run("search", *data, "--model", "tfidf")
    run("train", *corpus, "--vectors", vectors, "--window", "2", "--epochs", "1", "--min_count", "1", "--vector_size", "4")
    assert "auc" in run("roc-auc", *pairs, "--vectors", vectors) and "f1" in run("max-f1", *pairs, "--vectors", vectors)
    assert "measure" in run("cascade", *pairs, *corpus, "--scenario", f"{files}/k.csv", "--vectors", f"{files}/models")
    run("timings", *data, "--model", "tfidf", "--out", f"{files}/t.csv")
    assert "swapped" in run("timings-report", "--path", f"{files}/t.csv")
    assert "driver_mb" in run("memory", *data, "--model", "tfidf")
    run("preprocess", "--path", f"{files}/raw.parquet", "--field", "text", "--out", f"{files}/done.parquet")
    assert spark.read.parquet(f"{files}/done.parquet").first()["preprocessed_text"] == ["aa", "bb"]
    assert "transformer" in run("grand-total", *data)
    for bad in (["search", *data, "--model", "gpt"], ["evaluate", *data, "--model", "word2vec"], ["match", "a", "b", "--model", "none"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_readers_of_small_files(spark, files, tmp_path):
    assert R.read_benchmark(spark, f"{files}/s.csv", "text_1", "text_2").where("need_match").count() == 6
    assert R.read_corpus(spark, f"{files}/c.parquet").first()["tokens"] in (["aa", "bb"], ["dd", "ee"])
    assert [r["window"] for r in R.read_scenario(spark, f"{files}/k.csv").orderBy("step").collect()] == ["2", "x"]
    with pytest.raises(ValueError):
        R.read_any(spark, "a.txt")
    for n in range(2):
        SK.append_row(spark, f"{tmp_path}/r.csv", {"a": n})
    assert sorted(r["a"] for r in spark.read.csv(f"{tmp_path}/r.csv", header=True).collect()) == ["0", "1"]
    (tmp_path / "t.csv").write_text("time,process_time,text_1_len,text_2_len\n1.5,1,3,4\n", encoding="utf-8")
    assert tuple(R.read_timings(spark, f"{tmp_path}/t.csv").first()) == (1.5, 1.0, 3, 4)
    made = []
    for _ in range(2):
        assert SK.write_once(spark, f"{tmp_path}/once", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    SK.save_params(f"{tmp_path}/p/best.json", {"окно": 1})
    assert '"окно": 1' in (tmp_path / "p" / "best.json").read_text(encoding="utf-8")


def test_temporary_failures_are_tried_again():
    calls = []

    def flaky(messages):
        calls.append(messages)
        if len(calls) < 3:
            raise C.TemporaryFailure("busy")
        return "7"

    assert C.Retrying(flaky, 3, 0)([{"role": "user", "content": "?"}]) == "7" and len(calls) == 3
    calls.clear()
    with pytest.raises(C.TemporaryFailure):
        C.Retrying(flaky, 2, 0)([])
    with pytest.raises(C.TemporaryFailure):
        C.HttpTransport("http://127.0.0.1:9/none", "m", timeout=1)([])
