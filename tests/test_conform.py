from pyspark.sql import functions as F

from terralens.functions import conform as C


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def of(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_codes(spark):
    df = column(spark, ["5001", " 05001 ", "", None, "123456", "5001.0"])
    assert of(df, C.code("v")) == ["05001", "05001", "00000", None, "123456", "5001.0"]
    assert of(df, C.whole_code("v")) == ["05001", "05001", None, None, "123456", "05001"]


def test_numbers(spark):
    df = column(spark, ["12,5", "1,234.5", "", "nan", "x", None, "-3.25", "inf"])
    assert of(df, C.number("v")) == [12.5, None, None, None, None, None, -3.25, float("inf")]
    assert of(df, C.number("v", 0))[1:6] == [0.0] * 5


def test_names(spark):
    df = column(spark, ["PEÑÓN", "  puerto   rico ", "INÍRIDA", "São—Tomé", None])
    assert of(df, C.name_key("v")) == ["PENON", "PUERTO RICO", "INIRIDA", "SAOTOME", None]


def test_presence_and_flags(spark):
    df = column(spark, [0.0, None, float("nan"), 4.5], "double")
    assert of(df, C.present("v")) == [False, False, False, True]
    assert of(df, C.flag(F.col("v") > 1))[1:2] == [0] and of(df, C.flag(F.col("v") > 1))[3] == 1


def test_rounding(spark):
    df = column(spark, [0.5, 2.675, -0.5, 0.12345], "double")
    assert of(df, C.half_up("v", 0)) == [1.0, 3.0, 0.0, 0.0]
    assert of(df, C.clamp("v")) == [0.5, 1.0, 0.0, 0.12345]


def test_labels(spark):
    names = ("a", "b", "c")
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.5, 0.5, 0.0],)], "p array<double>")
    assert of(df, C.argmax("p")) == [1, 0] and of(df, C.label_of(C.argmax("p"), names)) == ["b", "a"]
    assert of(column(spark, ["c", "zz", None]), C.ordinal_of("v", names)) == [2, None, None]
    d = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0)], "x double, y double")
    assert of(d, C.dominant(("x", "y"))) == ["x", "y"]
    assert C.missing_columns(d, ["y", "z", "x", "w"]) == ["z", "w"]
