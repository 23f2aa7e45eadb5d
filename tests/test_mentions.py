"""Attribution by joins: names of a text against the catalog."""

from __future__ import annotations

from colscope.operators import mentions

CATALOG = [("SHOP.M.BOOKS.TITLE", "BOOKS", "TITLE"), ("SHOP.M.BOOKS.PRICE", "BOOKS", "PRICE"), ("SHOP.M.LOANS.DAYS", "LOANS", "DAYS"), ("SHOP.M.LOANS.TITLE", "LOANS", "TITLE")]
TEXTS = {
    "plain": "SELECT TITLE, SUM(PRICE) AS P FROM BOOKS WHERE PRICE > ?",
    "qualified": "SELECT B.TITLE FROM SHOP.M.BOOKS AS B JOIN LOANS AS L ON L.TITLE = B.TITLE",
    "ambiguous": "SELECT TITLE, DAYS FROM BOOKS JOIN LOANS AS L ON ? = ?",
    "union": "SELECT TITLE FROM BOOKS UNION ALL SELECT TITLE FROM LOANS ORDER BY 1",
    "elsewhere": "SELECT TITLE FROM OTHER.M.BOOKS",
    "star": "SELECT * FROM BOOKS WHERE PRICE > ?",
    "left out": "SELECT * EXCLUDE(PRICE) FROM BOOKS",
    "inner star": "WITH X AS (SELECT * FROM BOOKS WHERE PRICE IN (?)) SELECT MAX(TITLE) FROM X",
    "count": "SELECT COUNT(*) AS N FROM BOOKS",
}


def read(spark, texts, session=("SHOP", "M")):
    rows = spark.createDataFrame([(k, v, *session) for k, v in texts.items()], "text_id string, sql string, database_name string, schema_name string")
    catalog = spark.createDataFrame(CATALOG, "fqn string, table_name string, column_name string")
    out = {k: set() for k in texts}
    for r in mentions.mentions(rows, catalog, "SHOP", "M").collect():
        out[r["text_id"]].add((r["fqn"].removeprefix("SHOP.M.") if r["fqn"] else f"?{r['name']}", r["measured"], r["by_star"]))
    return out


def test_names_meet_their_tables_columns(spark):
    assert read(spark, TEXTS) == {
        "plain": {("BOOKS.TITLE", False, False), ("BOOKS.PRICE", True, False)},
        "qualified": {("BOOKS.TITLE", False, False), ("LOANS.TITLE", False, False)},
        "ambiguous": {("?TITLE", False, False), ("LOANS.DAYS", False, False)},
        "union": {("BOOKS.TITLE", False, False), ("LOANS.TITLE", False, False)},
        "elsewhere": set(),
        "star": {("BOOKS.TITLE", False, True), ("BOOKS.PRICE", False, False)},
        "left out": {("BOOKS.TITLE", False, True)},
        "inner star": {("BOOKS.TITLE", True, False), ("BOOKS.PRICE", False, False)},
        "count": set(),
    }


def test_bare_tables_need_a_session(spark):
    got = read(spark, TEXTS, (None, None))
    assert got["plain"] == got["star"] == set() and got["qualified"] == {("BOOKS.TITLE", False, False)}


def test_one_measure_sets_the_half(spark):
    texts = {"a": "SELECT SUM(PRICE) FROM BOOKS", "b": "SELECT AVG(DAYS), MIN(PRICE) FROM LOANS JOIN BOOKS ON ? = ?", "c": "SELECT MAX(DAYS) FROM LOANS"}
    rows = spark.createDataFrame([(k, v, "SHOP", "M") for k, v in texts.items()], "text_id string, sql string, database_name string, schema_name string")
    catalog = spark.createDataFrame(CATALOG, "fqn string, table_name string, column_name string")
    asked = spark.createDataFrame([(k, k) for k in texts], "text_id string, qid string")
    found = mentions.question_columns(mentions.mentions(rows, catalog, "SHOP", "M"), asked, catalog.where("column_name = 'PRICE'"))
    assert sorted((r["qid"], r["columns"], r["measures"], r["measure"], r["half"]) for r in found.collect()) == [
        ("a", 1, 1, "SHOP.M.BOOKS.PRICE", "no trap"), ("b", 2, 2, None, None), ("c", 1, 1, "SHOP.M.LOANS.DAYS", "filtered"),
    ]
