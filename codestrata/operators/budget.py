"""Token budgets over ordered snippets of many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import estimate_block, estimate_tokens

# Budget tiers, overhead, least and largest snippet.
TIERS = {"minimal": 500, "compact": 1000, "standard": 2000, "extended": 4000, "maximum": 8000}
OVERHEAD, LEAST_SNIPPET, MOST_SNIPPET = 100, 50, 500
TRUNCATED = "\n# ... (truncated)"


def prefix(df: DataFrame, group: str, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """Rows up to the first that would overflow the budget of its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def _able(ranked: DataFrame, group: str, least: str, budget: int) -> DataFrame:
    """The rows of each group that a fold can still take; exact, for any number of rows.

    A row takes its ``least`` tokens (one or more) if they are left, else nothing. What is
    left never grows, so once a row is refused all later ones of the same ``least`` are, and
    before that at most ``budget / least`` of them were taken. Behind these no row of that
    ``least`` can be taken, however many other rows lie between. Lists are bounded by the
    sum of budget / least over all sizes (about 13,000 rows for a budget of 1,900 and
    sizes up to 500).
    """
    same = Window.partitionBy(group, least).orderBy("n")
    return ranked.where((F.col(least) > 0) & (F.col(least) <= budget)).withColumn("__k", F.row_number().over(same)).where(F.col("__k") * F.col(least) <= budget)


def skip_fold(df: DataFrame, group: str, order: list[str], tokens: Column, budget: int, most: int | None = None) -> DataFrame:
    """(group, n, tokens): the ranks taken greedily, larger ones skipped; not a prefix sum."""
    w = Window.partitionBy(group).orderBy(*order)
    s = df.select(group, F.row_number().over(w).alias("n"), tokens.cast("int").alias("tokens"))
    fits = s if most is None else s.where(F.col("tokens") <= most)
    lists = _able(fits, group, "tokens", budget).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("l"))
    start = F.struct(F.lit(budget).alias("left"), F.expr("cast(array() as array<struct<n:int,tokens:int>>)").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["tokens"] <= acc["left"], F.struct((acc["left"] - x["tokens"]).alias("left"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    taken = lists.select(group, F.explode(F.aggregate("l", start, step)["taken"]).alias("t")).select(group, "t.n", "t.tokens")
    return taken.unionByName(fits.where("tokens = 0"))  # these always fit


def truncate_lines(code: Column, most: Column) -> Column:
    """The longest run of first lines whose estimate fits; null if less than the least snippet may be used.

    Estimates rise with length, so the right number of lines is the count of fitting prefixes.
    """
    lines = F.split(code, "\n")
    # lengths so far, one running sum with the breaks between
    ends = F.aggregate(lines, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.length(x)).cast("int"))))
    fits = F.size(F.filter(ends, lambda n: F.when(n == 0, 0).otherwise(F.floor(n / 4.0 * 1.1).cast("int") + 1) + 4 <= most))
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), fits), "\n"), F.when(fits < F.size(lines), F.lit(TRUNCATED)).otherwise(""))
    return F.when((most >= LEAST_SNIPPET) & (fits > 0), cut)


def estimate_injection(header: Column, snippets: Column, footer: Column) -> Column:
    """Tokens of a text to inject: header and footer as mixed text, each snippet (array) as a fenced block."""
    blocks = F.aggregate(F.transform(snippets, lambda s: estimate_block(s)), F.lit(0), lambda a, x: a + x)
    return estimate_tokens(F.coalesce(header, F.lit("")), "mixed") + F.coalesce(blocks, F.lit(0)) + estimate_tokens(F.coalesce(footer, F.lit("")), "mixed")


def fits(text: Column, tier: str = "standard") -> Column:
    return estimate_tokens(text, "mixed") <= TIERS[tier]


def remaining(used: Column, tier: str = "standard") -> Column:
    return F.greatest(F.lit(0), F.lit(TIERS[tier]) - used)


def allocate(df: DataFrame, group: str, order: list[str], code: str, tier: str = "standard") -> DataFrame:
    """Complete snippets only, each at most the largest snippet, within the tier's budget less the overhead."""
    return skip_fold(df, group, order, estimate_block(F.col(code)), TIERS[tier] - OVERHEAD, MOST_SNIPPET)


def allocate_truncating(df: DataFrame, group: str, order: list[str], code: str, tier: str = "standard") -> DataFrame:
    """(group, n, tokens, text): snippets in order while the least snippet is left; what is
    left takes one whole, or as many of its first lines as fit in it and in the largest snippet.

    The mark of a cut is charged too. An oversized snippet is taken whole if it fits.
    """
    budget = TIERS[tier] - OVERHEAD
    w = Window.partitionBy(group).orderBy(*order)
    size = lambda n: F.when(n == 0, 0).otherwise(F.floor(n / 4.0 * 1.1).cast("int") + 1) + 4
    # the ends of the first lines that make a text and may be kept: lengths so far, with the breaks between
    ranked = df.select(group, F.row_number().over(w).alias("n"), estimate_block(F.col(code)).alias("v"), F.col(code).alias("code"))
    ends = F.filter(F.aggregate(F.split("code", "\n"), F.expr("cast(array() as array<int>)"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.length(x)))), lambda n: (n > 0) & (size(n) <= MOST_SNIPPET))
    s = ranked.withColumn("ends", ends)
    # a row takes at least its first lines, or if they are too long all of it or nothing
    s = s.withColumn("least", F.when(F.size("ends") > 0, size(F.col("ends")[0])).otherwise(F.col("v")))
    lists = _able(s, group, "least", budget).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "v", "ends"))).alias("l"))
    start = F.struct(F.lit(budget).alias("left"), F.expr("cast(array() as array<struct<n:int,tokens:int,chars:int>>)").alias("taken"))
    mark = len(TRUNCATED)

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"]
        fit = F.filter(x["ends"], lambda n: size(n) <= F.least(left, F.lit(MOST_SNIPPET)))
        chars = F.when(x["v"] > left, F.try_element_at(fit, F.lit(-1)))  # null: whole
        tokens = F.when(x["v"] <= left, x["v"]).otherwise(size(chars + mark)).cast("int")
        took = F.struct((left - tokens).alias("left"), F.concat(acc["taken"], F.array(F.struct(x["n"].alias("n"), tokens.alias("tokens"), chars.alias("chars")))).alias("taken"))
        return F.when((left >= LEAST_SNIPPET) & tokens.isNotNull(), took).otherwise(acc)

    taken = lists.select(group, F.explode(F.aggregate("l", start, step)["taken"]).alias("t")).select(group, "t.*")
    text = F.when(F.col("chars").isNull(), F.col("code")).otherwise(F.concat(F.expr("substring(code, 1, chars)"), F.lit(TRUNCATED)))
    return ranked.select(group, "n", "code").join(taken, [group, "n"]).select(group, "n", "tokens", text.alias("text"))
