import random

import pytest
from pyspark.sql import functions as F

from sievetext.functions import text as T
from sievetext.sources.extract import extract_txt_lines

CODE_POINTS = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]


@pytest.fixture(scope="module")
def every_character(spark):
    """One row per code point of Unicode, surrounded by other text."""
    points = spark.range(1, 0x110000, numPartitions=8).filter("id < 55296 or id > 57343")
    utf32 = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    # The decoder takes U+FEFF for a byte order mark, so it is put in by hand.
    c = F.when(F.col("id") == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(utf32, "UTF-32"))
    return points.select("id", c.alias("c")).cache()


def python_normalized(text):
    """Runs of characters that are neither a comma nor white space, put together by single spaces."""
    words, word = [], ""
    for c in text + ",":
        if c == "," or c.isspace():
            words += [word] if word else []
            word = ""
        else:
            word += c
    return " ".join(words)


def test_normalize_equals_python_for_every_character(every_character):
    template = F.concat(F.lit(" a"), "c", F.lit("b"), "c", "c", F.lit(" "), "c", F.lit(" c ,,d  e"), "c")
    rows = every_character.select("id", T.normalize_text(template).alias("n")).toPandas()
    assert len(rows) == len(CODE_POINTS)
    for point, got in zip(rows["id"], rows["n"]):
        c = chr(point)
        assert got == python_normalized(f" a{c}b{c}{c} {c} c ,,d  e{c}"), hex(point)


def test_lines_equal_python_for_every_character(every_character):
    template = F.concat(F.lit("one "), "c", F.lit("two"), "c", "c", F.lit("\r\n  three "), "c")
    lines = F.filter(T.split_lines(template), lambda line: ~T.is_blank(line))
    rows = every_character.select("id", lines.alias("l")).toPandas()
    for point, got in zip(rows["id"], rows["l"]):
        c = chr(point)
        want = [x.strip() for x in f"one {c}two{c}{c}\r\n  three {c}".splitlines() if x.strip()]
        assert [x.strip() for x in got] == want, hex(point)


def test_decode_lossy_equals_python(spark):
    rng = random.Random(7)
    alphabet = [0x41, 0x0A, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xEF, 0xBB, 0xBF]
    samples = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(samples)], "i int, b binary")
    for row in df.select("i", T.decode_lossy(F.col("b")).alias("t")).collect():
        assert row.t == samples[row.i].decode("utf-8", errors="replace"), samples[row.i]


def test_normalize_null_and_long_runs(spark):
    df = spark.createDataFrame([(None,), ("a" + " " * 200_000 + "b",)], "t string")
    assert [r.n for r in df.select(T.normalize_text(F.col("t")).alias("n")).collect()] == ["", "a b"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("name", "index"),
    [
        ("input_data_2.csv", 2), ("upload_1.zip", 1), ("abc.zip", None), ("v1.2", 1), ("abc7", 7), ("a.b3.zip", 3),
        ("a1b.2", None), ("abc.7", None), (".5", 5), ("x5.", 5), ("dir9/abc.csv", None), ("x٣.zip", None),
    ],
)
def test_column_index_from_name(spark, name, index):
    assert value(spark, T.column_index_from_name(F.lit(name))) == index


def test_small_functions(spark):
    assert value(spark, T.fallback_category(F.lit("Find All The Burglary Reports X"))) == "find_all_the_burglar"
    assert value(spark, T.repeat_anchor(F.lit("q"), 5)) == ["q"] * 5
    line = T.render_line(F.lit("a.txt"), F.lit("pets"), F.lit('he said "hi"\nbye'))
    assert value(spark, line) == "a.txt : pets : \"he said 'hi' bye\""
    assert value(spark, T.longest_field(F.array(*map(F.lit, ["aa", "bbb", "ccc", "d"])))) == 1
    assert value(spark, T.longest_field(F.array().cast("array<string>"))) is None
    cells = F.array(F.lit(" x "), F.lit("  "), F.lit("\x1c"), F.lit("y"))
    assert value(spark, T.trim_and_compact(cells)) == ["x", "\x1c", "y"]
    assert value(spark, T.defaulted(F.lit(None).cast("string"), "N/A")) == "N/A"


def test_scored_line_rounds_ties_to_even(spark):
    for score in (0.78125, 0.40625, 0.65625, 1.0, 0.7):
        line = T.render_scored_line(F.lit("c"), F.lit(score), F.lit("t"))
        assert value(spark, line) == f'c : {score:.4f} : "t"'


def test_extract_txt_lines(spark):
    files = spark.createDataFrame([("a.txt", "l1\r\n\r\n  l2, x  \nbad�\n")], "filename string, content string")
    rows = extract_txt_lines(files).orderBy("row_no").collect()
    assert [r.content for r in rows] == ["l1", "l2 x", "bad�"]
