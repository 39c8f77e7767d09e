"""Quality filter, score and the balanced choice of the best samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions import pysource
from quern.functions.text import (
    collapse_spaces, has_triple_quotes, is_indented, matches_any, seeded_rank, strip,
    text_or_empty, unify_newlines,
)
from quern.operators.ordering import keep_first_text, top_per_group

# Instructions and code that a sample must not contain.
BAD_INSTRUCTIONS = (
    r"^\s*todo\b",
    r"^\s*fixme\b",
    r"^\s*test\b",
    r"^\s*deprecated\b",
    r"^\s*internal\b",
    r"实现 .* 模块的完整功能",
    r"实现 .* 模块的功能",
)
BAD_CODE = (
    r"\bpytest\b",
    r"\bunittest\b",
    r"\bmock\b",
    r"\bMock\b",
    r"\bassert\b",
    r"\bTODO\b",
    r"\bFIXME\b",
    r"\bpass\s*(#.*)?$",
    r"NotImplementedError",
    r"raise\s+NotImplemented",
    r"if\s+__name__\s*==\s*['\"]__main__['\"]",
    r"argparse\.",
    r"click\.",
)


@dataclass(frozen=True)
class Rules:
    """Limits and pattern lists; the defaults are the fixed values for Python samples."""

    sample_type: str = "code_comment"
    instruction_chars: tuple[int, int] = (10, 160)
    code_chars: tuple[int, int] = (100, 2000)
    require_indentation: bool = True
    bad_instructions: Sequence[str] = BAD_INSTRUCTIONS
    bad_code: Sequence[str] = BAD_CODE
    max_imports: int = 3
    shape_points: Mapping[str, int] = field(
        default_factory=lambda: {"function": 40, "class": 30}
    )

    def but(self, **changes) -> "Rules":
        return replace(self, **changes)


def normalised(items: DataFrame) -> DataFrame:
    """White space of the instruction collapsed, newlines of the code unified, both stripped."""
    return items.withColumn(
        "instruction", collapse_spaces(text_or_empty("instruction"))
    ).withColumn("code", strip(unify_newlines(text_or_empty("code"))))


def text_reason(rules: Rules, corrupt: Column | None = None) -> Column:
    """First failing rule among those that need no parser, cheapest first."""
    instruction, code = F.col("instruction"), F.col("code")
    least_i, most_i = rules.instruction_chars
    least_c, most_c = rules.code_chars
    chain = F.when(F.lit(False) if corrupt is None else corrupt, "json_decode_error")
    chain = (
        chain.when(~F.col("type").eqNullSafe(rules.sample_type), "not_code_comment")
        .when(instruction == "", "empty_instruction")
        .when(code == "", "empty_code")
        .when(F.length(instruction) < least_i, "instruction_too_short")
        .when(F.length(instruction) > most_i, "instruction_too_long")
        .when(F.length(code) < least_c, "code_too_short")
        .when(F.length(code) > most_c, "code_too_long")
    )
    if rules.require_indentation:
        chain = chain.when(~is_indented(code), "no_indentation")
    return (
        chain.when(matches_any(instruction, rules.bad_instructions), "bad_instruction_pattern")
        .when(matches_any(code, rules.bad_code), "bad_code_pattern")
    )


def shape_of(facts: Column) -> Column:
    """function, class or other by the one top-level node that is not an import."""
    kinds = F.filter(facts["top_kinds"], lambda k: k != "import")
    only = F.get(kinds, F.lit(0))
    return F.when(~facts["syntax_ok"], "invalid").when(
        (F.size(kinds) == 1) & only.isin("function", "class"), only
    ).otherwise("other")


def syntax_reason(rules: Rules, facts: Column, shape: Column) -> Column:
    return (
        F.when(~facts["syntax_ok"], "invalid_python")
        .when(~shape.isin("function", "class"), "not_function_or_class")
        .when(facts["import_count"] > rules.max_imports, "too_many_imports")
        .when(facts["top_level_defs"] != 1, "multiple_top_level_defs")
    )


def quality_score(
    shape: Column, instruction: Column, code: Column, imports: Column, defs: Column,
    points: Mapping[str, int],
) -> Column:
    """Sum of the points below."""
    def worth(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)
    total = F.lit(0)
    for name, value in points.items():
        total = total + worth(shape == name, value)
    n_code, n_instruction = F.length(code), F.length(instruction)
    for condition, value in [
        (n_code.between(200, 1200), 25),
        (n_code.between(1201, 2000), 10),
        (n_instruction.between(20, 120), 20),
        (n_instruction.between(10, 19), 8),
        (is_indented(code), 15),
        (imports <= 2, 10),
        (defs == 1, 10),
        (has_triple_quotes(code), 5),
    ]:
        total = total + worth(condition, value)
    return total


def judge(items: DataFrame, rules: Rules = Rules(), corrupt: Column | None = None) -> DataFrame:
    """Every sample with ``reason`` (NULL if it is a candidate), ``shape`` and ``score``.

    Only samples that pass the text rules are handed to the parser.
    """
    facts = F.col("facts")
    parsed = (
        normalised(items).withColumn("reason", text_reason(rules, corrupt))
        .withColumn("facts", pysource.snippet_facts(
            F.when(F.col("reason").isNull(), F.col("code"))
        ))
        .withColumn("shape", F.when(facts.isNotNull(), shape_of(facts)))
    )
    score = quality_score(
        F.col("shape"), F.col("instruction"), F.col("code"), facts["import_count"],
        facts["top_level_defs"], rules.shape_points,
    )
    return (
        parsed.withColumn("reason", F.coalesce(
            "reason", syntax_reason(rules, facts, F.col("shape"))
        ))
        .withColumn("score", F.when(F.col("reason").isNull(), score))
        .drop("facts")
    )


def judge_text(items: DataFrame, rules: Rules, shape: Column) -> DataFrame:
    """``judge`` for texts that are not code: the shape is given, nothing is parsed."""
    checked = normalised(items).withColumn("reason", text_reason(rules)).withColumn("shape", shape)
    score = quality_score(
        F.col("shape"), F.col("instruction"), F.col("code"), F.lit(0), F.lit(1),
        rules.shape_points,
    )
    return checked.withColumn("score", F.when(F.col("reason").isNull(), score))


def without_rejected_text(judged: DataFrame) -> DataFrame:
    """What a hand-over table needs: texts of candidates only, reasons of all."""
    keep = F.col("reason").isNull()
    return judged.withColumns(
        {name: F.when(keep, F.col(name)) for name in ("instruction", "code")}
    )


def candidates(judged: DataFrame) -> DataFrame:
    """Samples without a reason, one per exact code; the smallest source line wins."""
    kept = judged.filter(F.col("reason").isNull()).drop("reason")
    return keep_first_text(kept, "code", ["source_line"])


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("source_line")]


def balanced_keys(
    pool: DataFrame, target: int, major: str = "function", minor: str = "class",
    minor_share: float = 0.2,
) -> DataFrame:
    """(source_line, score, shape) of the chosen samples.

    The minor shape gets at most its share, the major shape the rest; what is still missing is
    filled from all others by score.  Only the best ``target`` rows of each of three groups can
    be chosen, so the quota arithmetic runs on at most 3 * target narrow rows.
    """
    group = F.when(F.col("shape") == major, 0).when(F.col("shape") == minor, 1).otherwise(2)
    narrow = pool.select("source_line", "score", "shape", group.alias("_group"))
    best = top_per_group(narrow, ["_group"], best_first(), target, rank="_rank")

    everything = Window.partitionBy()
    in_minor = F.count_if(F.col("_group") == 1).over(everything)
    minor_quota = F.least(in_minor, F.lit(int(target * minor_share)))
    by_quota = (
        (F.col("_group") == 0) & (F.col("_rank") <= target - F.col("_minor"))
        | (F.col("_group") == 1) & (F.col("_rank") <= F.col("_minor"))
    )
    refill = Window.partitionBy("_chosen").orderBy(*best_first())
    return (
        best.withColumn("_minor", minor_quota)
        .withColumn("_chosen", by_quota)
        .withColumn("_missing", target - F.count_if(F.col("_chosen")).over(everything))
        .withColumn("_turn", F.row_number().over(refill))
        .filter(F.col("_chosen") | (F.col("_turn") <= F.col("_missing")))
        .select("source_line", "score", "shape")
    )


def shuffled(chosen: DataFrame, seed: int = 42) -> DataFrame:
    """Rank in a seeded order; the input holds at most the target number of rows."""
    order = Window.orderBy(seeded_rank(seed, "source_line"), "source_line")
    return chosen.withColumn("shuffle_rank", F.row_number().over(order))


# A key row takes well under 100 bytes; beyond this many rows Spark chooses the join itself.
BROADCAST_KEYS = 500_000


def select_balanced(
    pool: DataFrame, target: int, seed: int = 42, **shares
) -> DataFrame:
    """The chosen samples in shuffled order.  Texts are joined to the chosen keys at the end, so
    the top-k steps move narrow rows only."""
    keys = shuffled(balanced_keys(pool, target, **shares), seed)
    keys = keys.select("source_line", "shuffle_rank")
    if target <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return pool.join(keys, "source_line").orderBy("shuffle_rank")


def rejects(judged: DataFrame) -> DataFrame:
    """Lines that a rule left out, by line number."""
    return judged.filter(F.col("reason").isNotNull()).select(
        F.lit("select").alias("stage"), F.col("source_line").cast("string").alias("key"), "reason",
        F.lit(None).cast("string").alias("detail"),
    )


def skip_reasons(judged: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("reason").isNotNull()).groupBy("reason")
        .agg(F.count(F.lit(1)).alias("samples")).orderBy(F.desc("samples"), "reason")
    )


def _counts_map(df: DataFrame, key: str) -> DataFrame:
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # The groups are the rule names or shapes, a handful of rows.
    return counted.agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(key, "n")))
    ).alias("counts"))


def selection_report(
    judged: DataFrame, pool: DataFrame, chosen: DataFrame, input_path: str = "",
    output_path: str = "",
) -> DataFrame:
    """One row: totals, score range and the two count maps, put together by scalar subqueries."""
    n = F.count(F.lit(1))
    return chosen.agg(
        F.lit(input_path).alias("input_path"), F.lit(output_path).alias("output_path"),
        n.alias("selected_count"),
        F.coalesce(F.min("score"), F.lit(0)).alias("score_min"),
        F.coalesce(F.max("score"), F.lit(0)).alias("score_max"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score_avg"),
    ).select(
        "input_path", "output_path",
        judged.agg(n.alias("n")).scalar().alias("total_seen"),
        pool.agg(n.alias("n")).scalar().alias("filtered_count"),
        "selected_count",
        _counts_map(chosen, "shape").scalar().alias("shape_counts"),
        "score_min", "score_max", "score_avg",
        _counts_map(judged, "reason").scalar().alias("skip_reasons"),
    )
