"""Which catalog columns each query text reads, and in which clause.

The token table is summarised to one row per text (its relations, column references,
select items and query frames). Names are bound inside that row, so the only join is the
one that needs data from elsewhere: the catalog's columns per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.contracts import REFERENCE_KINDS
from colscope.functions.sqltext import let
from colscope.operators.tokens import (
    context_id,
    distinct_texts,
    is_name,
    names_source,
    reads_column,
    scoped,
    token_rows,
    unfollowed,
)
from colscope.plans.stages import staged

# The clause names references are reported under.
REPORTED = {
    "select": "select",
    "on": "join",
    "join": "join",
    "where": "where",
    "group_by": "group_by",
    "having": "having",
    "order_by": "order_by",
}



def _unquoted(part: Column) -> Column:
    return F.regexp_replace(part, '^"|"$', "")


def _parts(name: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(
            name, F.lit(r'"[^"]*+(?:""[^"]*+)*+"|[\p{L}_][\p{L}\p{N}_$]*|\*'), F.lit(0)
        ),
        _unquoted,
    )


def _when(condition: Column, value: Column) -> Column:
    return F.collect_list(F.when(condition, value))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def summaries(scoped_tokens: DataFrame) -> DataFrame:
    """One row per text with everything binding reads, gathered in one pass.

    A group is one query text, which already fitted one row.
    """
    tok, nxt = F.col("tok"), F.col("next")
    parts = _parts(tok)
    last = F.element_at(parts, -1)
    qualifier = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    alias_after = F.when(nxt == "AS", _unquoted(F.col("next2")))
    closes = F.col("closes_query")
    in_from = F.col("clause").isin("from", "join", "on") & F.col("at_top")
    derived = closes & in_from & F.coalesce(nxt == "AS", F.lit(False))
    cte = closes & F.col("at_top") & (F.col("clause") == "with")
    top_select = F.col("at_top") & (F.col("clause") == "select") & F.col("scope").isNotNull()
    # The last token of a select item tells its output name.
    aliased = F.coalesce(F.col("prev") == "AS", F.lit(False)) & is_name(tok)
    alone = F.coalesce(F.col("prev").isin("SELECT", "DISTINCT", ",", "ALL"), F.lit(False))
    star = alone & ((tok == "*") | tok.endswith(".*"))
    ordinal = (
        F.col("at_top")
        & (F.col("clause") == "group_by")
        & tok.rlike("^[0-9]+$")
        & F.coalesce(F.col("prev").isin("BY", ","), F.lit(False))
    )
    using = F.coalesce(F.col("opener_prev") == "USING", F.lit(False))
    return (
        scoped_tokens.groupBy("text_id")
        .agg(
            F.first("database_name").alias("database_name"),
            F.first("schema_name").alias("schema_name"),
            _when(
                _flag(names_source() & F.col("scope").isNotNull()),
                F.struct(
                    F.col("pos"),
                    F.col("scope"),
                    F.coalesce(alias_after, last).alias("alias"),
                    parts.alias("parts"),
                    F.lit(None).cast("int").alias("child"),
                ),
            ).alias("tables"),
            _when(
                _flag(derived),
                F.struct(
                    F.col("pos"),
                    F.col("scope"),
                    alias_after.alias("alias"),
                    F.array().cast("array<string>").alias("parts"),
                    F.col("child"),
                ),
            ).alias("derived"),
            _when(
                _flag(cte),
                F.struct(
                    F.col("pos"),
                    F.col("qframe"),
                    F.col("child"),
                    _unquoted(F.col("cte_name")).alias("name"),
                ),
            ).alias("ctes"),
            _when(
                _flag(closes),
                F.struct(
                    F.col("child").alias("qframe"),
                    F.col("pos").alias("close"),
                    # A subquery may read its surroundings; a derived table or CTE may not.
                    (~(derived | cte)).alias("correlates"),
                ),
            ).alias("closings"),
            _when(
                _flag(F.col("at_top") & (tok == "SELECT")),
                F.struct(
                    F.col("pos").alias("scope"),
                    F.col("qframe"),
                    F.coalesce(nxt == "DISTINCT", F.lit(False)).alias("distinct"),
                ),
            ).alias("scopes"),
            _when(
                _flag(F.col("at_top") & tok.isin("UNION", "INTERSECT", "EXCEPT", "MINUS")),
                F.struct(
                    F.col("qframe"),
                    (~F.coalesce((tok == "UNION") & (nxt == "ALL"), F.lit(False))).alias("dedups"),
                ),
            ).alias("sets"),
            _when(
                _flag(F.col("at_top") & (tok == "GROUP") & F.col("scope").isNotNull()),
                F.col("scope"),
            ).alias("grouped"),
            _when(
                _flag(top_select & F.col("item_end")),
                F.struct(
                    F.col("scope"),
                    F.col("item"),
                    F.when(aliased, _unquoted(tok)).alias("alias"),
                    F.when(aliased, _unquoted(tok))
                    .when(alone & is_name(tok) & ~star, last)
                    .alias("name"),
                    star.alias("star"),
                    F.when(star & (tok != "*"), F.element_at(parts, -2)).alias("star_of"),
                    tok.alias("text"),
                ),
            ).alias("items"),
            _when(
                _flag(reads_column()),
                F.struct(
                    F.col("pos"),
                    F.col("scope"),
                    F.col("item"),
                    F.col("clause"),
                    qualifier.alias("qualifier"),
                    last.alias("name"),
                    tok.alias("text"),
                    using.alias("using"),
                ),
            ).alias("columns"),
            _when(
                _flag(ordinal & F.col("scope").isNotNull()),
                F.struct(F.col("scope"), tok.try_cast("int").alias("item")),
            ).alias("ordinals"),
            _when(
                _flag(F.col("scope").isNotNull() & F.col("clause").isin("select", "order_by")),
                F.struct("scope", "clause", "item", "pos", "tok"),
            ).alias("written"),
        )
    )


def _with_frames(df: DataFrame) -> DataFrame:
    """Every scope's end, every frame's close, and every relation's CTE or table name."""
    far = F.lit(1 << 30)

    def close_of(qframe: Column) -> Column:
        found = F.filter("closings", lambda c: c["qframe"] == qframe)
        return F.coalesce(F.get(F.transform(found, lambda c: c["close"]), F.lit(0)), far)

    def correlates(qframe: Column) -> Column:
        return F.exists("closings", lambda c: (c["qframe"] == qframe) & c["correlates"])

    def end_of(s: Column) -> Column:
        later = F.filter(
            "scopes", lambda t: (t["qframe"] == s["qframe"]) & (t["scope"] > s["scope"])
        )
        return F.coalesce(
            F.array_min(F.transform(later, lambda t: t["scope"])), close_of(s["qframe"])
        )

    ended = df.withColumn(
        "scopes",
        F.transform(
            "scopes",
            lambda s: F.struct(
                s["scope"].alias("scope"),
                s["qframe"].alias("qframe"),
                s["distinct"].alias("distinct"),
                end_of(s).alias("end"),
                correlates(s["qframe"]).alias("correlates"),
            ),
        ),
    )

    def scope_end(scope: Column) -> Column:
        return F.get(
            F.transform(F.filter("scopes", lambda s: s["scope"] == scope), lambda s: s["end"]),
            F.lit(0),
        )

    def cte_of(t: Column) -> Column:
        # The innermost CTE of that name defined before the reference, in a frame around it.
        seen = F.filter(
            "ctes",
            lambda c: (F.size(t["parts"]) == 1)
            & (c["name"] == F.get(t["parts"], F.lit(0)))
            & (c["pos"] < t["pos"])
            & (c["qframe"] < t["pos"])
            & (t["pos"] < close_of(c["qframe"])),
        )
        return F.array_max(
            F.transform(seen, lambda c: F.struct(c["qframe"], c["pos"], c["child"].alias("child")))
        )["child"]

    def full_name(t: Column) -> Column:
        n = F.size(t["parts"])
        part = lambda back: F.try_element_at(t["parts"], F.lit(-back))
        return F.when(
            n > 0,
            F.struct(
                F.when(n >= 3, part(3)).otherwise(F.col("database_name")).alias("db"),
                F.when(n >= 2, part(2)).otherwise(F.col("schema_name")).alias("schema"),
                part(1).alias("table"),
            ),
        )

    def relation(t: Column) -> Column:
        child = F.coalesce(t["child"], cte_of(t))
        return F.struct(
            t["pos"].alias("pos"),
            t["scope"].alias("scope"),
            scope_end(t["scope"]).alias("end"),
            t["alias"].alias("alias"),
            child.alias("child"),
            F.when(child.isNull(), full_name(t)).alias("full"),
        )

    return ended.withColumn(
        "sources", F.transform(F.concat("tables", "derived"), relation)
    ).drop("tables", "derived")


def _with_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each relation's kind, table name and columns, read from the catalog.

    The one join of attribution: distinct (text, table) pairs against one row per table.
    """
    tables = (
        catalog.withColumn("table_fqn", F.regexp_replace("fqn", r"\.[^.]+$", ""))
        .groupBy("table_fqn")
        .agg(F.sort_array(F.collect_set("column_name")).alias("known"))
    )
    full = F.col("s.full")
    qualified = full["db"].isNotNull() & full["schema"].isNotNull()
    # An outer explode: Spark turns a plain one into a filter on the array, which it would
    # push below the steps that compute it and so compute them twice.
    exploded = df.select("text_id", F.explode_outer("sources").alias("s")).where(
        F.col("s").isNotNull()
    ).withColumn(
        "table_fqn", F.when(qualified, F.concat_ws(".", full["db"], full["schema"], full["table"]))
    )
    kind = (
        F.when(F.col("s.child").isNotNull(), F.lit(None))
        .when(~qualified, "unresolved")
        .when(full["schema"] == "INFORMATION_SCHEMA", "information_schema")
        .when(F.col("known").isNotNull(), "resolved")
        .otherwise("unmanaged")
    )
    bound = (
        exploded.join(tables, "table_fqn", "left")
        .groupBy("text_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("s.pos").alias("pos"),
                        F.col("s.scope").alias("scope"),
                        F.col("s.end").alias("end"),
                        F.col("s.alias").alias("alias"),
                        F.col("s.child").alias("child"),
                        F.col("table_fqn").alias("table_fqn"),
                        kind.alias("kind"),
                        F.when(F.col("s.child").isNull(), F.coalesce("known", F.array())).alias(
                            "names"
                        ),
                    )
                )
            ).alias("sources")
        )
    )
    return df.drop("sources").join(bound, "text_id", "left").withColumn(
        "sources",
        F.coalesce(
            "sources",
            F.array().cast(bound.schema["sources"].dataType),
        ),
    )


def _first_scope(qframe: Column) -> Column:
    return F.array_min(
        F.transform(F.filter("scopes", lambda s: s["qframe"] == qframe), lambda s: s["scope"])
    )


def _starred(item: Column, scope: Column) -> Column:
    """The sources a star item of a scope expands over."""
    return F.filter(
        "sources",
        lambda s: (s["scope"] == scope)
        & (item["star_of"].isNull() | (s["alias"] == item["star_of"])),
    )


def _with_outputs(df: DataFrame) -> DataFrame:
    """Each relation's output names, derived tables and CTEs included.

    A fold over the frames from the inside out: a producer closes before its consumer
    reads it. An output list holding ``*`` has columns that aren't known.
    """

    def names_of(source: Column, acc: Column) -> Column:
        return F.when(
            source["child"].isNotNull(),
            F.coalesce(F.try_element_at(acc, source["child"]), F.array(F.lit("*"))),
        ).when(source["kind"] == "resolved", source["names"]).otherwise(F.array(F.lit("*")))

    def outputs(qframe: Column, acc: Column) -> Column:
        scope = _first_scope(qframe)
        own = F.filter("items", lambda i: i["scope"] == scope)

        def item_names(item: Column) -> Column:
            return F.when(
                item["star"],
                F.flatten(F.transform(_starred(item, scope), lambda s: names_of(s, acc))),
            ).otherwise(F.array(F.coalesce(item["name"], F.lit(""))))

        return F.flatten(F.transform(own, item_names))

    frames = F.array_sort(
        F.transform("closings", lambda c: F.struct(c["close"], c["qframe"].alias("qframe")))
    )
    folded = F.aggregate(
        frames,
        F.create_map().cast("map<int,array<string>>"),
        lambda acc, f: F.map_concat(acc, F.create_map(f["qframe"], outputs(f["qframe"], acc))),
    )
    named = df.withColumn("outputs", folded)
    return named.withColumn(
        "sources",
        F.transform(
            "sources",
            lambda s: s.withField(
                "names",
                F.when(
                    s["child"].isNotNull(),
                    F.coalesce(
                        F.try_element_at(F.col("outputs"), s["child"]), F.array(F.lit("*"))
                    ),
                ).otherwise(s["names"]),
            ),
        ),
    ).drop("outputs")


def _with_references(df: DataFrame) -> DataFrame:
    """Column references after select aliases and ordinals are replaced by what they name.

    A fold over the select items in order, so an alias that reads an earlier alias ends
    at its columns.
    """
    alias_clauses = ["where", "group_by", "having", "qualify"]

    def spelled(cols: Column, item: Column | None, clause: Column) -> Column:
        return F.transform(
            cols,
            lambda c: F.struct(
                c["pos"].alias("pos"),
                c["scope"].alias("scope"),
                (c["item"] if item is None else item).alias("item"),
                clause.alias("clause"),
                c["qualifier"].alias("qualifier"),
                c["name"].alias("name"),
                c["text"].alias("text"),
                c["using"].alias("using"),
            ),
        )

    def aliased(c: Column, acc: Column) -> Column:
        return F.filter(
            acc,
            lambda a: (a["scope"] == c["scope"])
            & c["qualifier"].isNull()
            & (a["alias"] == c["name"]),
        )

    select_columns = F.filter("columns", lambda c: c["clause"] == "select")

    def step(acc: Column, item: Column) -> Column:
        own = F.filter(
            select_columns,
            lambda c: (c["scope"] == item["scope"]) & (c["item"] == item["item"]),
        )
        replaced = F.flatten(
            F.transform(
                own,
                lambda c: let(
                    aliased(c, acc),
                    lambda hit: F.when(
                        F.size(hit) > 0,
                        spelled(F.get(hit, F.lit(0))["cols"], c["item"], F.lit("select")),
                    ).otherwise(F.array(c)),
                ),
            )
        )
        return F.concat(
            acc,
            F.array(
                F.struct(
                    item["scope"].alias("scope"),
                    item["item"].alias("item"),
                    item["alias"].alias("alias"),
                    replaced.alias("cols"),
                )
            ),
        )

    column_type = df.schema["columns"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<scope:int,item:bigint,alias:string,cols:{column_type}>>")
    ordered = F.array_sort("items")
    with_items = df.withColumn("item_cols", F.aggregate(ordered, empty, step))

    def expanded(c: Column) -> Column:
        return let(
            aliased(c, F.col("item_cols")),
            lambda hit: F.when(
                c["clause"].isin(*alias_clauses) & (F.size(hit) > 0),
                spelled(F.get(hit, F.lit(0))["cols"], None, c["clause"]),
            ).otherwise(F.array(c)),
        )

    def written(scope: Column, item: Column, clause: str) -> Column:
        toks = F.filter(
            "written",
            lambda w: (w["scope"] == scope)
            & (w["item"] == item)
            & (w["clause"] == clause)
            & ~w["tok"].isin("SELECT", "DISTINCT", ",", "BY", "ASC", "DESC", "NULLS", "FIRST", "LAST"),
        )
        text = F.array_join(
            F.transform(F.array_sort(F.transform(toks, lambda w: F.struct(w["pos"], w["tok"].alias("tok")))), lambda w: w["tok"]),
            " ",
        )
        return F.regexp_replace(text, r" AS \S+$", "")

    def names_output(c: Column) -> Column:
        # ORDER BY a selected name or a selected expression reads the projection.
        by_name = c["qualifier"].isNull() & F.exists(
            "items", lambda i: (i["scope"] == c["scope"]) & (i["name"] == c["name"])
        )
        by_text = F.array_contains(F.col("grouped"), c["scope"]) & let(
            written(c["scope"], c["item"], "order_by"),
            lambda text: F.exists(
                "items",
                lambda i: (i["scope"] == c["scope"])
                & (written(i["scope"], i["item"], "select") == text),
            ),
        )
        return (c["clause"] == "order_by") & (_flag(by_name) | _flag(by_text))

    others = F.filter(
        "columns", lambda c: (c["clause"] != "select") & ~_flag(names_output(c))
    )
    ordinals = F.flatten(
        F.transform(
            "ordinals",
            lambda o: F.flatten(
                F.transform(
                    F.filter(
                        "item_cols",
                        lambda i: (i["scope"] == o["scope"]) & (i["item"] == o["item"]),
                    ),
                    lambda i: spelled(i["cols"], None, F.lit("group_by")),
                )
            ),
        )
    )
    # An inner ORDER BY keeps the outputs it names.
    order_names = F.filter(
        "columns", lambda c: (c["clause"] == "order_by") & c["qualifier"].isNull()
    )
    return (
        with_items.withColumn("others", F.concat(F.flatten(F.transform(others, expanded)), ordinals))
        .withColumn("selected", F.flatten(F.transform("item_cols", lambda i: i["cols"])))
        .withColumn("order_names", order_names)
        .drop("columns", "ordinals", "written", "grouped", "item_cols")
    )


def _with_bindings(df: DataFrame) -> DataFrame:
    """Each reference's source: none, one, or several for a USING column."""
    using_names = F.transform(
        F.filter("others", lambda c: c["using"]), lambda c: F.struct(c["scope"], c["name"].alias("name"))
    )
    prepared = df.withColumn("using_names", using_names)

    def innermost(sources: Column) -> Column:
        deepest = F.array_max(F.transform(sources, lambda s: s["scope"]))
        return F.filter(sources, lambda s: s["scope"] == deepest)

    def candidates(c: Column) -> Column:
        around = F.filter(
            "sources", lambda s: (s["scope"] <= c["pos"]) & (c["pos"] <= s["end"])
        )
        by_alias = innermost(F.filter(around, lambda s: s["alias"] == c["qualifier"]))
        holding = F.filter(around, lambda s: F.array_contains(s["names"], c["name"]))
        own = F.filter(holding, lambda s: s["scope"] == c["scope"])
        correlates = F.exists(
            "scopes", lambda s: (s["scope"] == c["scope"]) & s["correlates"]
        )
        outer = innermost(F.filter(holding, lambda s: s["scope"] < c["scope"]))
        joined = F.exists(
            "using_names", lambda u: (u["scope"] == c["scope"]) & (u["name"] == c["name"])
        )
        unqualified = let(
            F.when(F.size(own) > 0, own).when(correlates, outer).otherwise(own),
            lambda found: F.when((F.size(found) == 1) | joined, found).otherwise(
                F.slice(found, 1, 0)
            ),
        )
        return F.when(c["qualifier"].isNotNull(), by_alias).otherwise(unqualified)

    def unattributed(scope: Column) -> Column:
        kinds = F.array_distinct(
            F.transform(
                F.filter("sources", lambda s: (s["scope"] == scope) & s["child"].isNull()),
                lambda s: s["kind"],
            )
        )
        return let(
            kinds,
            lambda k: F.when(
                (F.size(k) == 1)
                & F.get(k, F.lit(0)).isin("unmanaged", "information_schema"),
                F.get(k, F.lit(0)),
            ).otherwise("unresolved"),
        )

    def ref(kind: Column, name: Column, c: Column, child: Column) -> Column:
        return F.struct(
            kind.alias("kind"),
            name.alias("name"),
            F.coalesce(
                F.try_element_at(
                    F.create_map(*[F.lit(x) for kv in REPORTED.items() for x in kv]), c["clause"]
                ),
                F.lit("other"),
            ).alias("clause"),
            c["scope"].alias("scope"),
            c["item"].alias("item"),
            # What a derived source must output for this reference: "frame.name".
            F.when(
                child.isNotNull(), F.concat_ws(".", child.cast("string"), c["name"])
            ).alias("reads"),
        )

    def bound(c: Column) -> Column:
        def one(s: Column) -> Column:
            known = F.array_contains(s["names"], c["name"])
            derived = s["child"].isNotNull()
            kind = (
                F.when(derived, F.when(known | F.array_contains(s["names"], F.lit("*")), "derived").otherwise("unresolved"))
                .when(s["kind"] == "resolved", F.when(known, "resolved").otherwise("unresolved"))
                .otherwise(s["kind"])
            )
            name = F.when(
                kind == "resolved", F.concat_ws(".", s["table_fqn"], c["name"])
            ).otherwise(c["text"])
            return ref(kind, name, c, s["child"])

        return let(
            candidates(c),
            lambda found: F.when(F.size(found) > 0, F.transform(found, one)).otherwise(
                F.array(ref(unattributed(c["scope"]), c["text"], c, F.lit(None).cast("int")))
            ),
        )

    def star_refs(item: Column) -> Column:
        """Columns a select star reads, or one reference when they aren't known."""
        over = _starred(item, item["scope"])
        everything = F.filter("sources", lambda s: s["scope"] == item["scope"])
        tables = F.exists(everything, lambda s: s["child"].isNull())
        opaque = lambda s: s["child"].isNull() & (s["kind"] != "resolved")
        star = F.struct(
            F.lit("select").alias("clause"), item["scope"].alias("scope"), item["item"].alias("item"),
            F.lit("*").alias("name"),
        )
        none = F.lit(None).cast("int")
        unknown = (
            F.when(item["star_of"].isNull(), unattributed(item["scope"]))
            .when(F.size(over) > 0, F.get(over, F.lit(0))["kind"])
            .otherwise(unattributed(item["scope"]))
        )

        def columns_of(s: Column) -> Column:
            return F.when(
                s["child"].isNotNull(),
                F.array(ref(F.lit("derived"), F.lit("*"), star, s["child"])),
            ).otherwise(
                F.transform(
                    s["names"],
                    lambda n: ref(F.lit("resolved"), F.concat_ws(".", s["table_fqn"], n), star, none),
                )
            )

        return (
            F.when((F.size(over) > 0) & ~F.exists(over, opaque), F.flatten(F.transform(over, columns_of)))
            .when(tables, F.array(ref(unknown, item["text"], star, none)))
            .otherwise(F.slice(F.array(ref(unknown, item["text"], star, none)), 1, 0))
        )

    stars = F.flatten(F.transform(F.filter("items", lambda i: i["star"]), star_refs))
    return (
        prepared.withColumn("other_refs", F.flatten(F.transform("others", bound)))
        .withColumn("item_refs", F.flatten(F.transform("selected", bound)))
        .withColumn("star_refs", stars)
        .drop("others", "selected", "using_names")
    )


def _with_liveness(df: DataFrame) -> DataFrame:
    """The outputs of derived tables and CTEs that the query around them reads.

    A fold over the frames from the outside in: a consumer closes after its producer. A
    live output is ``frame.name``, ``frame.*`` when all of them are.
    """
    key = lambda frame, name: F.concat_ws(".", frame.cast("string"), name)
    consumed = F.array_distinct(
        F.transform(F.filter("sources", lambda s: s["child"].isNotNull()), lambda s: s["child"])
    )
    reads_of = lambda refs: F.filter(
        F.transform(refs, lambda r: r["reads"]), lambda r: r.isNotNull()
    )
    always = F.array_distinct(
        F.concat(
            # A frame no FROM list reads (the query itself, an IN list) keeps everything.
            F.transform(
                F.filter("scopes", lambda s: ~F.array_contains(F.col("consumed"), s["qframe"])),
                lambda s: key(s["qframe"], F.lit("*")),
            ),
            # DISTINCT and deduplicating set operations compare whole rows.
            F.transform(
                F.filter("scopes", lambda s: s["distinct"]), lambda s: key(s["qframe"], F.lit("*"))
            ),
            F.transform(
                F.filter("sets", lambda s: s["dedups"]), lambda s: key(s["qframe"], F.lit("*"))
            ),
            # An inner ORDER BY keeps the outputs it names.
            F.transform(
                "order_names",
                lambda c: key(
                    F.get(
                        F.transform(
                            F.filter("scopes", lambda s: s["scope"] == c["scope"]),
                            lambda s: s["qframe"],
                        ),
                        F.lit(0),
                    ),
                    c["name"],
                ),
            ),
            reads_of("other_refs"),
        )
    )

    def output_name(scope: Column, item: Column) -> Column:
        # Outputs go by the first branch's names, position by position.
        qframe = F.get(
            F.transform(F.filter("scopes", lambda s: s["scope"] == scope), lambda s: s["qframe"]),
            F.lit(0),
        )
        first = _first_scope(qframe)
        return F.get(
            F.transform(
                F.filter("items", lambda i: (i["scope"] == first) & (i["item"] == item)),
                lambda i: i["name"],
            ),
            F.lit(0),
        )

    def frame_of(scope: Column) -> Column:
        return F.get(
            F.transform(F.filter("scopes", lambda s: s["scope"] == scope), lambda s: s["qframe"]),
            F.lit(0),
        )

    located = (
        df.withColumn("consumed", consumed)
        .withColumn(
            "item_refs",
            F.transform(
                "item_refs",
                lambda r: r.withField("frame", frame_of(r["scope"])).withField(
                    "output", output_name(r["scope"], r["item"])
                ),
            ),
        )
        .withColumn(
            "star_refs",
            F.transform("star_refs", lambda r: r.withField("frame", frame_of(r["scope"]))),
        )
        .withColumn("always", always)
    )

    def is_live(live: Column, frame: Column, name: Column) -> Column:
        return F.array_contains(live, key(frame, F.lit("*"))) | _flag(
            F.array_contains(live, key(frame, name))
        )

    # The last part of a resolved star reference is the output it gives.
    last = lambda name: F.substring_index(name, ".", -1)
    frames = F.reverse(
        F.array_sort(
            F.transform("closings", lambda c: F.struct(c["close"], c["qframe"].alias("qframe")))
        )
    )

    def step(live: Column, f: Column) -> Column:
        frame = f["qframe"]
        from_items = reads_of(
            F.filter(
                "item_refs",
                lambda r: (r["frame"] == frame) & is_live(live, frame, r["output"]),
            )
        )
        whole = F.array_contains(live, key(frame, F.lit("*")))
        prefix = F.concat(frame.cast("string"), F.lit("."))
        wanted = F.transform(
            F.filter(live, lambda k: k.startswith(prefix)),
            lambda k: F.substr(k, F.length(prefix) + 1),
        )
        # A star over a derived table passes the wanted names on.
        from_stars = F.flatten(
            F.transform(
                F.filter(
                    "star_refs", lambda r: (r["frame"] == frame) & r["reads"].isNotNull()
                ),
                lambda r: F.when(whole, F.array(r["reads"])).otherwise(
                    F.transform(
                        wanted, lambda n: F.concat(F.regexp_extract(r["reads"], r"^(-?\d+\.)", 1), n)
                    )
                ),
            )
        )
        return F.array_union(live, F.concat(from_items, from_stars))

    # The query itself reads its sources first.
    root = F.struct(F.lit(1 << 30).alias("close"), F.lit(-1).alias("qframe"))
    subqueries_first = F.concat(F.array(root), frames)
    live = F.aggregate(subqueries_first, F.col("always"), step)
    alive = located.withColumn("live", live)
    return alive.withColumn(
        "refs",
        F.concat(
            F.transform(
                "other_refs",
                lambda r: F.struct(r["kind"].alias("kind"), r["name"].alias("name"), r["clause"].alias("clause")),
            ),
            F.transform(
                F.filter(
                    "item_refs", lambda r: is_live(F.col("live"), r["frame"], r["output"])
                ),
                lambda r: F.struct(r["kind"].alias("kind"), r["name"].alias("name"), r["clause"].alias("clause")),
            ),
            F.transform(
                F.filter(
                    "star_refs",
                    lambda r: (r["kind"] != "resolved")
                    | is_live(F.col("live"), r["frame"], last(r["name"])),
                ),
                lambda r: F.struct(r["kind"].alias("kind"), r["name"].alias("name"), r["clause"].alias("clause")),
            ),
        ),
    )


def analysed(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(text_id, top_star, refs) per distinct text, refs as an array of (kind, name, clause).

    A text of a shape that isn't followed has null refs: nothing is guessed from it. The
    texts are written first: a filter on them would else move below the step that makes them
    distinct and look at each query.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = staged(texts, "distinct").repartition(width, "text_id")
    left_out = texts.where(unfollowed(F.col("sql"))).select("text_id")
    summary = summaries(scoped(token_rows(texts.where(~unfollowed(F.col("sql"))))))
    steps = (
        _with_frames,
        lambda d: _with_catalog(d, catalog),
        _with_outputs,
        _with_references,
        _with_bindings,
        _with_liveness,
    )
    done = reduce(lambda d, step: step(d), steps, summary)
    top_scopes = F.transform(
        F.filter("scopes", lambda s: s["qframe"] == -1), lambda s: s["scope"]
    )
    followed = done.select(
        "text_id",
        F.exists("items", lambda i: i["star"] & F.array_contains(top_scopes, i["scope"])).alias(
            "top_star"
        ),
        F.array_distinct(F.filter("refs", lambda r: r["kind"] != "derived")).alias("refs"),
    )
    return followed.unionByName(left_out, allowMissingColumns=True)


def text_references(texts_analysed: DataFrame) -> DataFrame:
    """(text_id, kind, name, clause), distinct per text."""
    return texts_analysed.select("text_id", F.inline_outer("refs")).where(
        F.col("kind").isNotNull()
    )


def with_text_id(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("text_id", context_id())


def query_references(snapshot: DataFrame, texts_analysed: DataFrame) -> DataFrame:
    """(query_id, kind, name, clause) of every query, from its text's references.

    A hot text's queries are split by AQE's skew join; its references are few rows.
    """
    per_text = text_references(texts_analysed)
    return (
        with_text_id(snapshot)
        .select("query_id", "text_id")
        .join(per_text, "text_id")
        .select("query_id", "kind", "name", "clause")
    )


def weighted_references(snapshot: DataFrame, texts_analysed: DataFrame) -> DataFrame:
    """(kind, name, clause, queries): each text's references with the number of its queries, so
    that counts make no (query, reference) row."""
    weights = with_text_id(snapshot).groupBy("text_id").agg(F.count(F.lit(1)).alias("queries"))
    return text_references(texts_analysed).join(weights, "text_id").select("kind", "name", "clause", "queries")


def column_refs(references: DataFrame) -> DataFrame:
    """The resolved references: (query_id, fqn, clause)."""
    return references.where(F.col("kind") == "resolved").select(
        "query_id", F.col("name").alias("fqn"), "clause"
    )


def reference_counts(snapshot: DataFrame, texts_analysed: DataFrame) -> DataFrame:
    """References per kind, every kind listed, queries read, unattributable and starred.

    Counted per text and weighted by the text's queries, so no (query, reference) row is
    made for a count.
    """
    weights = with_text_id(snapshot).groupBy("text_id").agg(F.count(F.lit(1)).alias("queries"))
    weighted = weights.join(texts_analysed, "text_id", "left")
    per_kind = [
        F.sum(
            F.col("queries")
            * F.coalesce(F.size(F.filter("refs", lambda r: r["kind"] == k)), F.lit(0))
        ).alias(f"columns_{k}")
        for k in REFERENCE_KINDS
    ]
    return weighted.agg(
        F.sum("queries").alias("queries_read"),
        F.sum(F.when(F.col("refs").isNull(), F.col("queries")).otherwise(0)).alias(
            "queries_qualify_failed"
        ),
        F.sum(F.when(F.col("top_star"), F.col("queries")).otherwise(0)).alias("queries_top_level_star"),
        *per_kind,
    )
