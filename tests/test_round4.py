"""Cheaper forms of the extraction against the plain ones they stand for."""

from itertools import product

from pyspark.sql import functions as F

from policylake import rules as R
from policylake.functions import extract as X
from policylake.functions import relevance as V
from policylake.functions import text as T
from policylake.streaming import documents as SD


def calls(column, name):
    return column._jc.toString().count(f"{name}(")


def test_texts_are_looked_at_once_before_they_are_cleaned(spark):
    signs = ["", "甲", " ", "\t", "\n", "　", "\xa0"]
    texts = [None] + sorted({"".join(p) for n in range(5) for p in product(signs, repeat=n)})
    runs = F.regexp_replace(F.regexp_replace(F.replace("t", F.lit("　"), F.lit(" ")), "[ \t]+", " "), "\n{3,}", "\n\n")
    plain = F.btrim(runs, F.lit(T.WHITESPACE))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.filter(~T.clean_text("t").eqNullSafe(plain) | ~T.compact("t").eqNullSafe(F.replace(plain, F.lit("\n"), F.lit(" "))))
    assert wrong.count() == 0
    assert calls(T.clean_text("t"), "transform") == calls(T.compact("t"), "transform") == 1


def test_titles_that_a_page_has_not_are_not_cleaned(spark):
    texts = [None, "", "短\n关于国补的通知书\n第二行文字内容", " 　一二三四五六 \n", "甲乙丙丁戊己庚辛"]
    df = spark.createDataFrame([(t, m) for t in texts for m in (None, "", " ", "短题", "页面上的长标题 - 某某商务局")], "t string, m string")
    none, m = F.lit(None).cast("string"), F.col("m")
    same = lambda a, b: df.filter(~a.eqNullSafe(b)).count() == 0
    absent = X.infer_title(F.col("t"), None, None, None)
    assert same(absent, X.infer_title(F.col("t"), none, none, none)) and same(X.infer_title(F.col("t"), None, m, None), X.infer_title(F.col("t"), F.lit(""), m, F.lit("")))
    got = {(r["t"], r["m"]): r["v"] for r in df.select("t", "m", X.infer_title(F.col("t"), None, None, m)["value"].alias("v")).collect()}
    assert got[texts[2], "页面上的长标题 - 某某商务局"] == "页面上的长标题" and got[texts[2], "短题"] == got[texts[2], None] == "关于国补的通知书"
    assert got[texts[3], " "] == "一二三四五六" and got[None, "短题"] is None and got["", ""] is None
    assert calls(absent, "regexp_replace") < calls(X.infer_title(F.col("t"), none, none, none), "regexp_replace")


def test_words_that_do_not_occur_get_no_points(spark):
    words = [("甲乙", 3), ("乙", 2), ("丙", 5), ("没有", 7)]
    df = spark.createDataFrame([(t, b) for t in ("", "甲乙", "丙丙") for b in ("", "乙", "甲乙甲乙乙", "丙甲乙")], "t string, b string")

    def brute(title, body):
        out = []
        for word, weight in words:
            points = weight * 145 if word in title else None
            if word in body:
                points = weight * ((145 if word in title else 100) + 45 * min(2, body.count(word)) + 8)
            out += [(word, points, word in title)] * (points is not None)
        return out

    hits = V.keyword_hits(F.col("t"), F.col("b"), F.col("b"), [R.Weighted(w, p) for w, p in words])
    for r in df.select("t", "b", hits.alias("h")).collect():
        assert [tuple(h) for h in r["h"]] == brute(r["t"], r["b"])
    assert hits._jc.toString().startswith("transform(filter(")


def test_a_batch_of_files_is_looked_up_by_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(40):  # more than the driver looks up by itself
        (tmp_path / "in" / f"{i}.txt").write_text(f"content {i}")
    name, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before = spark.conf.get(name)

    def write(docs, batch):
        seen.append((int(docs.sparkSession.conf.get(name)), docs.select("content_hash").distinct().count()))

    SD.stream_documents(SD.read_file_stream(spark, str(tmp_path / "in")), write, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(max(64, 4 * spark.sparkContext.defaultParallelism), 40)] and spark.conf.get(name) == before
