"""Gold aggregates and their alternative readings as parametrized plans.

A question is data about a plan: the measure it sums, its filters, its group key and the
key its labels join on. A reading rebinds named columns before the plan runs, so swapping
a column is one projection that Catalyst folds away.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.ordering import global_row_number
from colscope.operators.marts import MONEY


@dataclass(frozen=True)
class Swap:
    """Another reading: columns read as expressions, and a filter on what reads them.

    ``where`` is a real filter: a conditional sum would keep a group it empties.
    """

    replace: Mapping[str, Callable[[], Column]]
    where: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Question:
    """A gold aggregate: sum ``measure`` per ``group`` under ``filters``."""

    id: str
    category: str
    text: str
    measure: str
    filters: Mapping[str, Callable[[Column], Column]]
    group: str | None = None
    label: tuple[str, str, str] | None = None  # dimension name, its key, its label column
    ordered: bool = False
    descending: bool = False
    top: int | None = None
    trap: str | None = None
    accept: tuple[str, ...] = ()
    rule_out: Mapping[str, str] = field(default_factory=dict)

    def columns(self) -> set[str]:
        """The fact columns the question reads."""
        return {self.measure, *self.filters, *([self.group] if self.group else [])}


def applies(question: Question, swap: Swap) -> bool:
    """Whether the question reads any column the swap replaces."""
    return bool(question.columns() & set(swap.replace))


def _read(column: str, swap: Swap) -> Column:
    """A column as a swap has it read."""
    return swap.replace[column]() if column in swap.replace else F.col(column)


class _Places:
    """Columns as readings read them, each once, in an array of one type: ``kind``, or decimals of up to
    ``kind``'s scale as they are."""

    def __init__(self, fact: DataFrame, kind: str):
        self.fact, self.kind, self.held = fact, kind, {}

    def place(self, column: str | None, name: str, swap: Swap) -> int:
        """Where the column stands; the null stands first."""
        if column is None:
            return 0
        self.held.setdefault((column, name if column in swap.replace else ""), _read(column, swap))
        return 1 + list(self.held).index((column, name if column in swap.replace else ""))

    def array(self) -> Column:
        kind = T.DataType.fromDDL(self.kind)
        fields = self.fact.select(*self.held.values()).schema.fields
        fits = lambda t: isinstance(kind, T.DecimalType) and isinstance(t, T.DecimalType) and t.precision <= 18 and t.scale <= kind.scale
        columns = [c if fits(f.dataType) else c.cast(self.kind) for c, f in zip(self.held.values(), fields, strict=True)]
        return F.array(F.lit(None), *columns)


def result_rows(
    fact: DataFrame,
    dims: Mapping[str, DataFrame],
    questions: Sequence[Question],
    swaps: Mapping[str, Swap],
) -> DataFrame:
    """Every applicable reading of every question, gold included, as one long table:
    (qid, variant, grp, amount). The gold's variant is ''.

    The fact is scanned once, whatever the number of readings: a row becomes one (reading, group,
    measure) for each reading whose filters keep it, and these are summed on the map side, so that only the
    readings' groups shuffle. A row holds each group key and measure once, however many readings share it, and a
    reading finds its own by place; readings with the same filters are kept or dropped together. A filter function
    picks a row's readings: as one expression fused with the scan and the sums, they make a method that the JVM
    won't compile.
    A swap's filter reads the fact's own columns, and like any filter it drops a group it empties. Labels, bounds
    and empty totals are seen to on the groups.
    """
    plans = [
        (q, name, swap)
        for q in questions
        for name, swap in [("", Swap({})), *sorted(swaps.items())]
        if not name or applies(q, swap)
    ]
    labels = sorted({q.label for q in questions if q.label})
    keys, measures = _Places(fact, "string"), _Places(fact, "decimal(28,6)")
    keeps: dict[tuple, tuple[Column, list[int]]] = {}
    listed, key_at, measure_at = [], [], []
    for i, (q, name, swap) in enumerate(plans):
        kept = [keep(_read(c, swap)) for c, keep in q.filters.items()]
        if swap.where is not None:
            kept.append(swap.where())
        # readings with the same filters on the same columns are kept together
        alike = tuple((c, keep, name if c in swap.replace else "") for c, keep in q.filters.items())
        keeps.setdefault((alike, swap.where), (reduce(Column.__and__, kept, F.lit(True)), []))[1].append(i)
        key_at.append(keys.place(q.group, name, swap))
        measure_at.append(measures.place(q.measure, name, swap))
        listed.append((q.id, name, q.group is None, labels.index(q.label) if q.label else None, q.top))
    told_by = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("r"))
    told = {
        n: told_by(values, kind)
        for (n, kind), values in zip(
            (("qid", "string"), ("variant", "string"), ("total", "boolean"), ("label", "int"), ("top", "int")), zip(*listed, strict=True), strict=True
        )
    }
    found = lambda values, at: F.get(values, told_by(at, "int"))
    together = [F.when(keep, F.array(*map(F.lit, held))) for keep, held in keeps.values()]
    rows = (
        fact.select(
            F.flatten(F.filter(F.array(*together), lambda r: r.isNotNull())).alias("_kept"),
            keys.array().alias("_keys"),
            measures.array().alias("_measures"),
        )
        .select(F.explode("_kept").alias("r"), "_keys", "_measures")
        .select("r", found(F.col("_keys"), key_at).alias("grp"), found(F.col("_measures"), measure_at).alias("m"))
    )
    # A total over no row is a row too, so each total has a row that adds nothing.
    each = fact.sparkSession.range(len(plans)).select(F.col("id").cast("int").alias("r"))
    nothing = each.where(told["total"]).select("r", F.lit(None).cast("string").alias("grp"), F.lit(None).cast("decimal(28,6)").alias("m"))
    summed = rows.unionByName(nothing).groupBy("r", "grp").agg(F.sum("m").alias("amount")).withColumns(told)
    if labels:
        names = reduce(
            DataFrame.unionByName,
            [
                dims[dim].select(F.lit(i).alias("label"), F.col(key).cast("string").alias("grp"), F.col(text).cast("string").alias("_text"))
                for i, (dim, key, text) in enumerate(labels)
            ],
        )
        # The groups meet their labels, not the fact's rows; one label may name several groups.
        found_label = names.withColumn("_named", F.lit(True))
        summed = (
            summed.join(found_label, ["label", "grp"], "left")
            .where("label is null or _named")
            .withColumn("grp", F.when(F.col("label").isNull(), F.col("grp")).otherwise(F.col("_text")))
            .groupBy("r", "qid", "variant", "top", "grp")
            .agg(F.sum("amount").alias("amount"))
        )
    best = Window.partitionBy("r").orderBy(F.col("amount").desc(), "grp")
    kept = summed.withColumn("_place", F.row_number().over(best)).where("top is null or _place <= top")
    return kept.select("qid", "variant", "grp", F.col("amount").cast(MONEY).alias("amount"))


def reading_matrix(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(qid, variant, same, problem): each reading compared with its gold.

    ``declared`` (qid, variant, declared, trap) lists what each question says of each
    swap: accept, rule_out or nothing. Rows compare as multisets by hash counts.
    """
    h = F.sha2(F.to_json(F.struct("grp", "amount"), {"ignoreNullFields": "false"}), 256)
    counted = rows.groupBy("qid", "variant", h.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    gold = counted.where(F.col("variant") == "").select("qid", "h", F.col("n").alias("gold_n"))
    sizes = rows.groupBy("qid", "variant").agg(F.count(F.lit(1)).alias("size"))
    gold_sizes = sizes.where(F.col("variant") == "").select("qid", F.col("size").alias("gold_size"))
    hits = (
        counted.where(F.col("variant") != "")
        .join(gold, ["qid", "h"])
        .groupBy("qid", "variant")
        .agg(F.sum(F.least("n", "gold_n")).alias("hits"))
    )
    compared = (
        sizes.where(F.col("variant") != "")
        .join(gold_sizes, "qid", "left")
        .join(hits, ["qid", "variant"], "left")
        .select(
            "qid",
            "variant",
            (
                (F.col("size") == F.coalesce("gold_size", F.lit(0)))
                & (F.coalesce("hits", F.lit(0)) == F.col("size"))
            ).alias("same"),
            F.lit(True).alias("read"),
        )
    )
    joined = declared.join(compared, ["qid", "variant"], "full_outer")
    says = F.coalesce("declared", F.lit(""))
    problem = (
        F.when(F.col("read").isNull() & (says != ""), "declared, reads none of its columns")
        .when((says == "") & ~F.col("same"), "changes the result, not declared")
        .when((says == "accept") & F.col("same"), "accepted, gives the gold's result")
        .when(F.coalesce("trap", F.lit(False)) & F.col("same"), "trap gives the gold's result")
    )
    return joined.where(F.col("read").isNotNull() | (says != "")).select(
        "qid", "variant", "same", problem.alias("problem")
    )


def with_measure(question: Question, renames: Mapping[str, str]) -> Question:
    """The question with its measure renamed to its filtered twin."""
    return replace(question, measure=renames.get(question.measure, question.measure))


#: What a ruled-out swap settles, and how many of these a question must settle.
FAMILIES = {"month": r"_month$", "region": r"^region_", "provider": r"^(customer|supplier|prescriber|executor)$"}
SETTLED = 2


def id_islands(questions: DataFrame) -> DataFrame:
    """Runs of contiguous ids (letters and a number): (prefix, low, high, ids).

    Distinct numbers are numbered over the whole table by range; a number less its place is the same all along a
    run, so the runs are one grouping and no row sees its neighbours.
    """
    parts = questions.select(
        F.regexp_extract("qid", r"^(\D*)", 1).alias("prefix"), F.regexp_extract("qid", r"(\d+)$", 1).try_cast("bigint").alias("number")
    )
    placed = global_row_number(parts.where("number is not null").distinct(), [("prefix", False), ("number", False)])
    return (
        placed.groupBy("prefix", (F.col("number") - F.col("row_no")).alias("_shift"))
        .agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("ids"))
        .drop("_shift")
    )


def balance_problems(questions: DataFrame, limits: Mapping[str, int], pilot: DataFrame | None = None) -> DataFrame:
    """Violations of a question set's balance: (rule, detail, found).

    ``questions``: qid, category, measure, trap, half, and for the last three rules ruled_out (swap names)
    and text. ``limits``: per_half, max_per_measure (filtered half), min_per_category, min_per_trap. Ids run
    from 1 without a gap, a question rules out swaps of two families of three, and none repeats an id or a
    text of ``pilot`` (qid, text), in whatever case.
    """
    def count_by(column: str) -> DataFrame:
        return questions.groupBy(F.col(column).alias("detail")).agg(
            F.count(F.lit(1)).alias("found")
        )

    halves = count_by("half").where(F.col("found") != limits["per_half"])
    measures = (
        questions.where(F.col("half") == "filtered")
        .groupBy(F.col("measure").alias("detail"))
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") > limits["max_per_measure"])
    )
    categories = count_by("category").where(F.col("found") < limits["min_per_category"])
    traps = count_by("trap").where(F.col("found") < limits["min_per_trap"])
    repeated = count_by("qid").where(F.col("found") > 1)
    named = {
        "half size": halves,
        "measure cap": measures,
        "category minimum": categories,
        "trap minimum": traps,
        "repeated id": repeated,
    }
    if pilot is not None:
        islands = id_islands(questions)
        # an island that starts past 1 tells the gap before it
        named["gap before id"] = islands.where("low > 1").select(
            F.concat("prefix", F.col("low").cast("string")).alias("detail"), F.col("ids").alias("found")
        )
        family = lambda pattern: F.exists("ruled_out", lambda s: s.rlike(pattern)).cast("int")
        settles = [family(pattern) for pattern in FAMILIES.values()]
        named["settles fewer than two"] = questions.select(
            F.col("qid").alias("detail"), reduce(Column.__add__, settles).cast("bigint").alias("found")
        ).where(F.col("found") < SETTLED)
        for rule, key in (("pilot id", F.col("qid")), ("pilot text", F.lower("text"))):
            seen = pilot.select(key.alias("_seen")).distinct()
            named[rule] = (
                questions.join(seen, key.eqNullSafe(F.col("_seen")), "left_semi").groupBy(F.col("qid").alias("detail")).agg(F.count(F.lit(1)).alias("found"))
            )
    return reduce(
        DataFrame.unionByName,
        [
            df.select(F.lit(rule).alias("rule"), F.col("detail").cast("string").alias("detail"), "found")
            for rule, df in named.items()
        ],
    )
