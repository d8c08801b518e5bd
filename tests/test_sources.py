"""Map readers on small files, and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemflow.sources import maps
from tandemflow.streaming import validation


def test_readers(spark, tmp_path):
    def write(name: str, text: str) -> str:
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    mq = maps.read_map(spark, "maxquant", write("mq.txt", "m/z\tRetention time\tCharge\tIntensity\tIntensities\n500.5\t2\t2\t\t7;3\n"))
    assert tuple(mq.select("mz", "t", "charge", "intensity").head()) == (500.5, 120.0, 2, 7.0)
    pg = maps.read_map(spark, "progenesis", write("pg.csv", "x\ny\n#;m/z;Retention time (min);Charge;A;B\n1;400.1;1;3;10;20\n"), samples=["A", "B"])
    assert sorted((r["sample"], r["intensity"]) for r in pg.collect()) == [("A", 10.0), ("B", 20.0)]
    om = maps.read_map(spark, "openms", write("f.featureXML", '<m><featureList><feature id="f1"><position dim="0">9.5</position><position dim="1">612.3</position><intensity>5</intensity><overallquality>0.5</overallquality><charge>2</charge></feature></featureList></m>'))
    assert tuple(om.select("mz", "t", "charge", "intensity").head()) == (612.3, 9.5, 2, 5.0)
    sh = maps.read_map(spark, "superhirn", write("s.xml", '<l><feature><coordinate mz="3.5" rt="2" intensity="8" charge="1"/><scan_range min="4" max="6"/></feature></l>'))
    assert tuple(sh.head()) == (3.5, 120.0, 1, 8.0, 4, 6)
    mi = maps.read_map(spark, "msinspect", write("m.tsv", "# date\nscan\ttime\tmz\ttotalIntensity\tcharge\tscanFirst\tscanLast\n5\t1.5\t300.1\t9\t2\t4\t6\n"))
    assert tuple(mi.head()) == (300.1, 1.5, 2, 9.0, 5, 4, 6)
    mf = maps.read_map(spark, "mfpaq", write("q.tsv", "c\tS\tm\ta\tf\tl\tx\n2+\t30\t450.2\t77\t1\t2\t1.5\n3+\t\t1\t1\t1\t1\t1\n"), map_number=1)
    assert [tuple(r) for r in mf.select("mz", "t", "charge", "intensity").collect()] == [(450.2, 90.0, 2, 77.0)]
    scans = spark.createDataFrame([(i, i, float(i)) for i in range(1, 8)], "scan_num long, cycle long, t double")
    d2 = maps.read_map(spark, "decon2ls", write("d.csv", "scan_num,mz,abundance,charge,fit\n1,500.0,1,2,0\n2,500.001,3,2,0\n3,500.0,1,2,0\n7,500.0,1,2,0\n"), scans=scans)
    assert [(r["intensity"], r["n_scans"]) for r in d2.collect()] == [(4.0, 3)]


def test_stream(spark, tmp_path):
    rows = [(1, 90.0, False, "2020-01-01 00:00:10"), (1, 10.0, True, "2020-01-01 00:00:20"), (2, 50.0, False, "2020-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "rs_id int, score double, is_decoy boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = validation.windowed_counts(stream, "at", "10 minutes", "1 minute", ["rs_id"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["rs_id"], r["target"], r["decoy"]) for r in spark.sql("SELECT * FROM counts").collect()} == {(1, 1, 1), (2, 1, 0)}
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(validation.validating(50.0, lambda b, n: b.write.mode("append").parquet(out))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).filter("is_validated").count() >= 1
