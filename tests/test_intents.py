import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievetext.operators import intents as I

SCHEMA = (
    "request_id long, usedNaturalLanguage boolean, naturalLanguageDescription string, "
    "fields struct<desiredOutcome:string,importantDate:string,importantPeople:string,importantEvents:string,importantLocation:string>, "
    "fileName string"
)
FULL = Row("Burglary", "12/2/23", "Jane Smith", "Went to London", "London, New York")


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ((0, False, None, FULL, "in.zip"), ""),
        ((0, None, None, FULL, "in.zip"), ""),
        ((0, False, None, Row("x", "  ", "x", "x", "x"), "in.zip"), "Input Error: Please enter an important date., "),
        ((0, True, "find it", None, "in.zip"), ""),
        ((0, True, " \n", FULL, "in.zip"), "Input Error: Please enter a natural language description., "),
        (
            (0, True, None, None, None),
            "Input Error: Please select a .zip file to upload., Input Error: Please enter a natural language description., ",
        ),
        (
            (0, False, "text", None, "in.zip"),
            "Input Error: Please enter a desired outcome., Input Error: Please enter an important date., "
            "Input Error: Please enter important people., Input Error: Please enter important events., "
            "Input Error: Please enter an important location., ",
        ),
    ],
)
def test_validation(spark, row, message):
    got = I.validate_requests(requests(spark, row)).first()
    assert (got.message, got.valid) == (message, message == "")


def test_split_description(spark):
    df = requests(spark, (0, True, "one. two;three\n. ", None, "f"), (1, True, None, None, "f"))
    assert [r.query for r in I.split_description(df).orderBy("request_id").collect()] == ["one. two;three\n. ", ""]
    parts = I.split_description(df, r"[.;\n]").orderBy("request_id", "sub").collect()
    assert [(r.request_id, r.sub, r.query) for r in parts] == [(0, 0, "one"), (0, 1, "two"), (0, 2, "three")]


def test_expand_queries(spark):
    queries = spark.createDataFrame([(0, "Find $1 \\X"), (1, "b c")], "ord long, query string")
    fallback = {r.ord: (r.category, r.anchors) for r in I.expand_queries(queries, num=2).collect()}
    assert fallback == {0: ("find_$1_\\x", ["Find $1 \\X"] * 2), 1: ("b_c", ["b c"] * 2)}
    templates = ["about {query}", "{query} and {query}"]
    want = {0: ["about Find $1 \\X", "Find $1 \\X and Find $1 \\X"], 1: ["about b c", "b c and b c"]}
    table = spark.createDataFrame(list(enumerate(templates))[::-1], "template_no int, template string")
    for given in (templates, table):
        assert {r.ord: r.anchors for r in I.expand_queries(queries, given).collect()} == want


def test_answers(spark):
    queries = spark.createDataFrame([(i, f"q {i}") for i in range(4)], "ord long, query string")
    answers = spark.createDataFrame(
        [(0, "cat", ["x", "y"]), (1, None, ["z"]), (2, "dog", None)], "ord long, category string, variations array<string>"
    )
    got = {r.ord: (r.category, r.anchors) for r in I.expand_queries(queries, num=2, answers=answers).collect()}
    assert got == {
        0: ("cat", ["x", "y"]), 1: ("general_query", ["z"]), 2: ("dog", ["q 2", "q 2"]), 3: ("q_3", ["q 3", "q 3"])
    }


def test_expand_fields(spark):
    templates = ["{importantPeople} in {importantLocation}", "{desiredOutcome} on {importantDate}", "{importantEvents}"]
    df = requests(
        spark,
        (0, False, None, FULL, "f"),
        (1, False, None, Row(" ", None, "A, ,B", "", "C"), "f"),
        (2, False, None, None, "f"),
    )
    got = {r.request_id: (r.category, r.anchors) for r in I.expand_fields(df, templates).collect()}
    first = ["Jane Smith in London", "Burglary on 12/2/23", "Went to London"]
    assert got[0] == ("structured_query", [*first, "Jane Smith in New York", "Burglary on 12/2/23", "Went to London"])
    assert got[1][1] == ["A in C", "N/A on N/A", "N/A", "B in C", "N/A on N/A", "N/A"]
    assert got[2][1] == []
    assert not any("Error" in a for _, anchors in got.values() for a in anchors)
    many = [f"{{importantLocation}} {i}" for i in range(30)]
    assert len(I.expand_fields(df.filter("request_id = 0"), many).first().anchors) == 60


def test_default_templates_use_every_field(spark):
    anchors = I.expand_fields(requests(spark, (0, False, None, FULL, "f"))).first().anchors
    assert len(anchors) == len(I.FIELD_TEMPLATES) * 2
    assert not any("{" in a for a in anchors)
    for word in ("Burglary", "12/2/23", "Jane Smith", "Went to London", "New York"):
        assert any(word in a for a in anchors)


def test_route_requests(spark):
    df = requests(
        spark, (0, True, "one. two", None, "f"), (1, False, "ignored", FULL, "f"), (2, None, None, FULL, "f")
    )
    rows = I.route_requests(df, separators=r"\.").orderBy("request_id", "ord").collect()
    assert [(r.request_id, r.ord, r.category) for r in rows] == [
        (0, 0, "one"), (0, 1, "two"), (1, 0, "structured_query"), (2, 0, "structured_query")
    ]
    table = I.build_filter_table(I.route_requests(df, separators=r"\."))
    assert table.columns == ["request_id", "ord", "category", "anchors"]
    places = [(r.request_id, r.ord) for r in table.orderBy("ord").collect()]
    assert places == [(0, 0), (0, 1), (1, 1 << 32), (2, 2 << 32)]
    table = I.build_filter_table(I.route_requests(df.filter("request_id = 0"), separators=r"\.").drop("request_id"))
    assert table.columns == ["ord", "category", "anchors"]
    assert table.agg(F.min(F.size("anchors")).alias("n")).first().n == 5


def test_defaulted_fields(spark):
    row = I.defaulted_fields(requests(spark, (0, False, None, Row(None, "", "x", None, "y"), "f"))).first()
    assert tuple(row.fields) == ("N/A", "", "x", "N/A", "y")


def test_a_second_answer_raises(spark):
    queries = spark.createDataFrame([(1, "one"), (2, "two")], "ord long, query string")
    answers = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["y"])], "ord long, category string, variations array<string>")
    with pytest.raises(Exception, match="more than one answer for ord 1"):
        I.expand_queries(queries, answers=answers).collect()
    assert I.expand_queries(queries, answers=answers.limit(0)).count() == 2
