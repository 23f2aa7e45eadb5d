"""Redaction and canonical text of logged SQL, as column expressions over token arrays.

A text is cut into tokens by one regular expression, and every later step maps, folds or
joins that array inside the row, so redaction needs no shuffle and no Python worker. The
canonical text is canonical by tokens, not by syntax tree: two spellings a tree printer
would unify keep two texts, except the rewrites listed in ``REWRITES`` and the optional
AS. When a text can't be understood it is dropped and counted, never guessed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token: comments, dollar-quoted, quoted and prefixed strings, quoted names, numbers,
# parameters, words, two-character operators, then any other character. Quantifiers on
# groups are possessive, so a long literal costs no stack.
TOKEN = (
    r"--[^\n]*|//[^\n]*|/\*(?s:.*?)\*/|/\*"
    r"|\$\$(?s:.*?)\$\$"
    r"|[nNxXbB]?'[^'\\]*+(?:(?:''|\\(?s:.))[^'\\]*+)*+'"
    r'|"[^"]*+(?:""[^"]*+)*+"'
    r"|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|\$[A-Za-z0-9_]+"
    r"|[\p{L}_][\p{L}\p{N}_$]*"
    r"|::|<>|!=|<=|>=|\|\||=>|->|\S"
)

# Words that are never an alias or a column name.
RESERVED = (
    "ALL AND ANY AS ASC ASOF AT BEFORE BETWEEN BY CASE COLLATE CONNECT CROSS CURRENT DESC "
    "DISTINCT ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FILTER FIRST FOLLOWING FOR FROM FULL "
    "GROUP HAVING IGNORE ILIKE IN INNER INTERSECT INTERVAL IS JOIN LAST LATERAL LEFT LIKE "
    "LIMIT MATCH_RECOGNIZE MINUS NATURAL NEXT NOT NULL NULLS OFFSET ON ONLY OR ORDER OUTER "
    "OVER PARTITION PIVOT PRECEDING QUALIFY RANGE RECURSIVE REGEXP RESPECT RIGHT RLIKE ROW "
    "ROWS SAMPLE SELECT SET SOME START TABLESAMPLE THEN TOP TRUE UNBOUNDED UNION UNPIVOT "
    "USING VALUES WHEN WHERE WINDOW WITH WITHIN"
).split()
# Reserved words that may be called like a function or end an operand.
CALLABLE_RESERVED = ["LEFT", "RIGHT", "EXISTS", "ANY", "SOME", "FIRST", "LAST"]
OPERAND_WORDS = ["END", "NULL", "TRUE", "FALSE"]
# Type names whose parenthesized numbers are structure, not values.
TYPES = (
    "NUMBER DECIMAL NUMERIC DEC VARCHAR CHAR CHARACTER NCHAR NVARCHAR STRING TEXT BINARY "
    "VARBINARY FLOAT TIME TIMESTAMP TIMESTAMP_NTZ TIMESTAMP_LTZ TIMESTAMP_TZ DATETIME VECTOR"
).split()
# Spellings with one canonical form.
REWRITES = {"!=": "<>"}
# Words that end an ordered list's item or open another clause.
ITEM_END = (
    "ASC DESC NULLS HAVING QUALIFY LIMIT ORDER UNION INTERSECT EXCEPT MINUS ROWS RANGE "
    "OFFSET FETCH"
).split() + [",", ")", ";"]
CLAUSE_WORDS = (
    "SELECT FROM WHERE HAVING QUALIFY LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS ROWS "
    "RANGE ORDER GROUP WINDOW"
).split()
DATE_PARTS = (
    "YEAR QUARTER MONTH WEEK DAY HOUR MINUTE SECOND MILLISECOND MICROSECOND DAYOFWEEK "
    "DAYOFYEAR EPOCH ISOWEEK ISOYEAR"
).split()

# Clause words with nothing to read after them: the text can't be a complete query.
DANGLING = (
    r" (?:SELECT|DISTINCT) (?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|UNION|\)|;|$)"
    r"| (?:FROM|JOIN) (?:WHERE|GROUP|HAVING|ORDER|LIMIT|SELECT|UNION|ON|\)|;|$)"
    r"| (?:WHERE|HAVING|QUALIFY|ON|AND|OR|BY|LIMIT)"
    r" (?:FROM|WHERE|GROUP|HAVING|ORDER|LIMIT|UNION|\)|;|$)"
)
IN_LIST = r" IN \((?:[?, +\-]++|NULL|TRUE|FALSE|DATE|TIMESTAMP|TIME|CURRENT_DATE)++\)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body``, so it is computed once per row."""
    return F.transform(F.array(value), body)[0]


# A number after a comparison or one of these words, which is neither an ordinal nor a list item.
_NUMBER_END = r"(?=[\s);]|$)"
VALUE_NUMBER = (
    r"((?:[=<>]|(?i)(?<![\p{L}\p{N}_$.])(?:LIMIT|OFFSET|SELECT)(?=\s))\s*)[0-9]+" + _NUMBER_END
)
VALUE_LIST = r"(?i)((?<![\p{L}\p{N}_$.])IN\s*\()\s*[0-9]+(?:\s*,\s*[0-9]+)*+\s*\)"
# Words that make a number or a string part of the structure.
STRUCTURAL = rf"(?i)(?<![\p{{L}}\p{{N}}_$])(?:DATE_TRUNC|{'|'.join(TYPES)})(?![\p{{L}}\p{{N}}_$])"


def without_values(sql: Column) -> Column:
    """A text with the same canonical text and problem, its plain values made alike.

    Logs repeat their queries under other values, so few of these texts are left to analyse.
    Only what surely is a value or a comment changes: numbers after a comparison, LIMIT,
    OFFSET or SELECT, IN lists of whole numbers, quoted strings, and line comments. A text
    with quoted names, parameters, escapes, type names or DATE_TRUNC stays as it is; strings
    stay beside comments and comments beside strings, where each could hide the other.
    """
    quoted, commented = sql.contains("'"), sql.rlike(r"--|//|/\*")
    plain = (
        F.when(quoted & ~commented, F.regexp_replace(sql, "'[^']*'", "''"))
        .when(~quoted & ~sql.rlike(r"//|/\*"), F.regexp_replace(sql, r"--[^\n]*", " "))
        .otherwise(sql)
    )
    numbered = F.regexp_replace(F.regexp_replace(plain, VALUE_LIST, "$10)"), VALUE_NUMBER, "$10")
    return F.when(sql.rlike(r'["$\\`]') | sql.rlike(STRUCTURAL), sql).otherwise(numbered)


def _is_text(token: Column) -> Column:
    return (token.endswith("'") & (F.length(token) > 1)) | (
        token.startswith("$$") & (F.length(token) > 3)
    )


def _classified(raw: Column) -> Column:
    """The tokens without comments, as ``struct(tok, cls)``.

    Classes: L literal, N name, R reserved word, D number, P parameter, O other.
    """
    kept = F.filter(
        raw,
        lambda t: ~(
            t.startswith("--") | t.startswith("//") | (t.startswith("/*") & (F.length(t) > 2))
        ),
    )

    def one(t: Column) -> Column:
        # The first character's code point tells the classes apart without a regex.
        first = F.ascii(t)
        upper = F.upper(t)
        word = first.between(97, 122) | first.between(65, 90) | (first == 95) | (first > 127)
        return (
            F.when(_is_text(t), F.struct(t.alias("tok"), F.lit("L").alias("cls")))
            .when(
                word,
                F.struct(
                    upper.alias("tok"),
                    F.when(upper.isin(*RESERVED), "R").otherwise("N").alias("cls"),
                ),
            )
            .otherwise(
                F.struct(
                    F.when(t == "!=", F.lit(REWRITES["!="])).otherwise(t).alias("tok"),
                    F.when(first.between(48, 57), "D")
                    .when(t == "?", "L")
                    .when(F.length(t) == 1, "O")
                    .when(first == 46, "D")
                    .when(first == 34, "N")
                    .when(first == 36, "P")
                    .otherwise("O")
                    .alias("cls"),
                )
            )
        )

    return F.transform(kept, one)


def _without_intervals(tokens: Column) -> Column:
    """An interval is one value: its keyword and its unit drop out, its quantity stays."""

    def opens(i: Column) -> Column:
        return (F.get(tokens, i)["tok"] == "INTERVAL") & F.get(tokens, i + 1)["cls"].isin("L", "D")

    def part_of_one(t: Column, i: Column) -> Column:
        return F.when(t["tok"] == "INTERVAL", opens(i)).when(
            t["tok"].isin(*DATE_PARTS), opens(i - 2)
        )

    return F.when(
        F.exists(tokens, lambda t: t["tok"] == "INTERVAL"),
        F.filter(tokens, lambda t, i: ~F.coalesce(part_of_one(t, i), F.lit(False))),
    ).otherwise(tokens)


def _levels(tokens: Column) -> Column:
    """``struct(kept, balanced)``: the positions of the numbers that are structure, and
    whether the parentheses balance.

    A fold over the few tokens that matter carries, per open parenthesis, whether its
    numbers are ordinals of a GROUP BY or ORDER BY list (G), type parameters (T) or
    values (-).
    """
    steps = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.struct(
                i.alias("at"),
                t["tok"].alias("tok"),
                t["cls"].alias("cls"),
            ),
        ),
        lambda t: (t["cls"] == "D") | t["tok"].isin("(", ")", "BY", *CLAUSE_WORDS),
    )
    start = F.struct(
        F.lit("-").alias("levels"),
        F.lit(True).alias("balanced"),
        F.array().cast("array<int>").alias("kept"),
    )

    def step(acc: Column, t: Column) -> Column:
        tok, levels = t["tok"], acc["levels"]
        prev = F.get(tokens, t["at"] - 1)["tok"]
        nxt = F.get(tokens, t["at"] + 1)["tok"]
        outer = F.substr(levels, F.lit(1), F.length(levels) - 1)
        level = F.right(levels, F.lit(1))
        ordinal = (
            (level == "G") & prev.isin("BY", ",") & (nxt.isNull() | nxt.isin(*ITEM_END))
        )
        moved = (
            F.when(t["cls"] == "D", levels)
            .when(tok == "(", F.concat(levels, F.when(prev.isin(*TYPES), "T").otherwise("-")))
            .when(tok == ")", outer)
            .when(tok == "BY", F.concat(outer, F.when(prev.isin("GROUP", "ORDER"), "G").otherwise("-")))
            .otherwise(F.concat(outer, F.lit("-")))
        )
        return F.struct(
            moved.alias("levels"),
            (acc["balanced"] & ~((tok == ")") & (F.length(levels) <= 1))).alias("balanced"),
            F.when(
                (t["cls"] == "D") & F.coalesce((level == "T") | ordinal, F.lit(False)),
                F.concat(acc["kept"], F.array(t["at"])),
            )
            .otherwise(acc["kept"])
            .alias("kept"),
        )

    return F.aggregate(
        steps,
        start,
        step,
        lambda acc: F.struct(
            acc["kept"].alias("kept"),
            (acc["balanced"] & (F.length(acc["levels"]) == 1)).alias("balanced"),
        ),
    )


def _ends_operand(token: Column) -> Column:
    return token["cls"].isin("N", "L", "D", "P") | token["tok"].isin(")", "]", *OPERAND_WORDS)


def _spaced(tokens: Column, kept: Column) -> Column:
    """One text: values as ``?``, every alias introduced by AS, canonical spacing, and IN
    lists of values collapsed."""

    def piece(t: Column, i: Column) -> Column:
        tok, cls = t["tok"], t["cls"]
        prev = F.get(tokens, i - 1)
        part = F.upper(F.regexp_replace(tok, "'", ""))
        names_part = (F.get(tokens, i - 2)["tok"] == "DATE_TRUNC") & part.isin(*DATE_PARTS)
        spelled = (
            F.when(
                cls == "L",
                F.when(names_part, F.concat(F.lit("'"), part, F.lit("'"))).otherwise("?"),
            )
            .when((cls == "D") & ~F.array_contains(kept, i), F.lit("?"))
            .when(
                tok.isin("NUMBER", "NUMERIC") & (F.get(tokens, i + 1)["tok"] == "("),
                F.lit("DECIMAL"),
            )
            .otherwise(tok)
        )
        tight = F.when(
            cls == "O",
            tok.isin(",", ")", ".", "::", ":", "[", "]")
            | prev["tok"].isin("(", ".", "::", ":", "[")
            | (
                (tok == "(")
                & ((prev["cls"] == "N") | prev["tok"].isin(*CALLABLE_RESERVED))
            )
            | (prev["tok"].isin("-", "+") & ~_ends_operand(F.get(tokens, i - 2))),
        ).otherwise(
            prev["tok"].isin("(", ".", "::", ":", "[")
            | (
                prev["tok"].isin("-", "+")
                & ~F.coalesce(_ends_operand(F.get(tokens, i - 2)), F.lit(False))
            )
        )
        aliased = (cls == "N") & _ends_operand(prev) & (prev["tok"] != "DOUBLE")
        return (
            F.when(i == 0, spelled)
            .when(tight, spelled)
            .when(aliased, F.concat(F.lit(" AS "), spelled))
            .otherwise(F.concat(F.lit(" "), spelled))
        )

    joined = F.array_join(F.transform(tokens, piece), "")
    return F.regexp_replace(joined, IN_LIST, " IN (?)")


def normalize_once(sql: Column) -> Column:
    """``struct(text, problem)``: the canonical text, or why there is none.

    Problems in their order: parse_error, multiple_statements, not_a_query.
    """

    def judged(tokens: Column) -> Column:
        def from_levels(levels: Column) -> Column:
            def from_shape(shape: Column) -> Column:
                first = F.regexp_extract(shape, r"^(?: \()* (\S+)", 1)
                is_query = first.isin("SELECT", "WITH")
                torn = (
                    F.exists(
                        tokens, lambda t: (t["cls"] != "L") & t["tok"].isin("'", '"', "$", "/*")
                    )
                    | ~levels["balanced"]
                )
                problem = (
                    F.when(F.size(tokens) == 0, "multiple_statements")
                    .when(torn | (is_query & shape.rlike(DANGLING)), "parse_error")
                    .when(shape.rlike(r" ; (?:; )*[^; ]"), "multiple_statements")
                    .when(~is_query, "not_a_query")
                )
                statement = F.filter(tokens, lambda t: t["tok"] != ";")
                return F.struct(
                    F.when(
                        problem.isNull(), let(statement, lambda s: _spaced(s, levels["kept"]))
                    ).alias("text"),
                    problem.alias("problem"),
                )

            # Literals are left out of the shape: a quoted text must not look like SQL.
            words = F.transform(
                tokens, lambda t: F.when(t["cls"] == "L", F.lit("?")).otherwise(t["tok"])
            )
            return let(F.concat(F.lit(" "), F.array_join(words, " ")), from_shape)

        return let(_levels(tokens), from_levels)

    tokens = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return let(let(_classified(tokens), _without_intervals), judged)


def normalize(sql: Column) -> Column:
    """``struct(text, problem)`` with the idempotence check: a canonical text must come
    back unchanged, or it is dropped as unstable."""

    def checked(first: Column) -> Column:
        def compared(second: Column) -> Column:
            stable = F.coalesce(second["text"] == first["text"], F.lit(False))
            return F.struct(
                F.when(stable, first["text"]).alias("text"),
                F.when(first["problem"].isNotNull(), first["problem"])
                .when(~stable, "unstable_normalization")
                .alias("problem"),
            )

        return F.when(first["problem"].isNotNull(), first).otherwise(
            let(normalize_once(first["text"]), compared)
        )

    return let(normalize_once(sql), checked)
