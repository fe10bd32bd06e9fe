"""Strategy files as rows: every line an entry with its place, and every problem a row with its line.

A strategy file is a mapping of sections in a small part of YAML (or JSON): sections hold single values, a mapping,
a list, a list of mappings or a mapping of lists.  Files go through windows by file, so many files are read in one
job; the checks are filters and groupings of entries, and the limits of numbers are a table.

Results for odd files: an empty file lacks all that is required; a line that cannot be read is a problem of its
own (``UNREADABLE_LINE``) and its value is missing; of keys given twice the later one counts; null texts are empty
files.  Two checks are stricter than usual on purpose: keys of no known section are warned of, and a switch that
would let a signal look ahead is refused wherever it stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sections, their keys, choices and limits.
REQUIRED = ["name", "description", "version", "author", "created_at"]
SECTIONS = {
    "universe": ["type", "symbols", "sector", "max_symbols"],
    "factors": ["name", "weight"],
    "regime": ["enabled", "adjust_confidence", "preferred_regimes"],
    "portfolio": ["method", "max_position_weight", "cash_buffer"],
    "risk": ["max_drawdown_limit", "max_turnover", "min_factor_confidence"],
    "execution": ["cost_model", "slippage_model", "slippage_bps", "max_adv_participation"],
    "validation": ["require_walk_forward", "minimum_ic", "minimum_coverage", "minimum_regime_sample"],
    "metadata": ["top_n"],
}
UNIVERSES = ["default", "custom", "sector", "etf", "large_cap"]
METHODS = ["equal_weight", "inverse_volatility", "risk_parity", "min_variance"]
SYMBOL = r"^[A-Z0-9][A-Z0-9.\-]{0,14}$"
#: (section, key, least, least allowed itself, most, most allowed itself, whole numbers only)
LIMITS = [
    ("portfolio", "max_position_weight", 0.0, False, 1.0, True, False),
    ("portfolio", "cash_buffer", 0.0, True, 1.0, False, False),
    ("validation", "minimum_ic", None, True, None, True, False),
    ("validation", "minimum_coverage", 0.0, True, 1.0, True, False),
    ("validation", "minimum_regime_sample", 0.0, True, None, True, True),
    ("execution", "slippage_bps", 0.0, True, None, True, False),
    ("execution", "max_adv_participation", 0.0, False, 1.0, True, False),
]
ERROR, WARNING = "ERROR", "WARNING"
# A line up to its comment: quoted parts may hold #.
CODE = r"""^((?:[^#'"]++|'[^']*+'|"(?:[^"\\]|\\.)*+")*+)(.?)"""
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ENTRY = "file string, line int, section string, item int, key string, value string, quoted boolean, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a folder's strategy files."""
    kinds = spark.read.text(path, wholetext=True, pathGlobFilter="*.{yaml,yml,json}")
    return kinds.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def _scalar(c: Column) -> tuple[Column, Column]:
    """The value without its quotes (null where it means nothing), and whether it had any."""
    quoted = c.rlike("""^(".*"|'.*')$""") & (F.length(c) >= 2)
    nothing = F.lower(c).isin("null", "none", "")
    return F.when(quoted, F.substr(c, F.lit(2), F.length(c) - 2)).when(~nothing, c), quoted


def yaml_entries(files: DataFrame) -> DataFrame:
    """(file, text) -> ENTRY: a row a line that holds something; items of lists count from 0."""
    lines = files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line", "raw"))
    lines = lines.withColumn("line", F.col("line") + 1).withColumn("open", F.regexp_extract("raw", CODE, 2).isin("'", '"'))
    lines = lines.withColumn("raw", F.rtrim(F.regexp_extract("raw", CODE, 1))).filter("open or trim(raw) <> ''")
    lines = lines.withColumn("body", F.ltrim("raw")).withColumn("indent", F.length("raw") - F.length("body"))
    is_item = F.col("body").startswith("- ") | (F.col("body") == "-")
    rest = F.when(is_item, F.trim(F.substr("body", F.lit(2)))).otherwise(F.col("body"))
    lines = lines.withColumn("is_item", is_item).withColumn("rest", rest)
    # only "name: x" opens a mapping in a list
    pair = F.when(F.col("is_item"), F.col("rest").rlike(r"^name\s*:(\s|$)")).otherwise(F.col("rest").contains(":"))
    lines = lines.withColumn("pair", pair).withColumn("k", F.when(F.col("pair"), F.trim(F.substring_index("rest", ":", 1))))
    text = F.when(F.col("pair"), F.trim(F.expr("substr(rest, instr(rest, ':') + 1)"))).otherwise(F.col("rest"))
    lines = lines.withColumn("v", text)

    # head of the section, then the first level under it, then the level under a row of that
    by_file = Window.partitionBy("file").orderBy("line")
    lines = lines.withColumn("top", F.col("indent") == 0).withColumn("head", F.sum(F.col("top").cast("int")).over(by_file))
    part = Window.partitionBy("file", "head").orderBy("line")
    lines = lines.withColumn("section", F.first("k").over(part)).withColumn("head_value", F.first("v").over(part)).withColumn("head_top", F.first("top").over(part))
    lines = lines.withColumn("d1", F.min(F.when(~F.col("top"), F.struct("line", "indent"))).over(Window.partitionBy("file", "head"))["indent"])
    lines = lines.withColumn("first", ~F.col("top") & (F.col("indent") == F.col("d1")))
    lines = lines.withColumn("row", F.sum(F.col("first").cast("int")).over(part))
    lines = lines.withColumn("item", F.when(F.col("row") > 0, F.sum((F.col("first") & F.col("is_item")).cast("int")).over(part) - 1))
    level = Window.partitionBy("file", "head", "row").orderBy("line")
    lines = lines.withColumn("deep", ~F.col("top") & ~F.col("first"))
    parent = lambda c: F.first(c).over(level)
    lines = lines.withColumn("p_item", parent("is_item")).withColumn("p_key", parent("k")).withColumn("p_value", parent("v")).withColumn("p_bare", parent(F.col("is_item") & (F.col("rest") == "")))
    lines = lines.withColumn("d2", F.min(F.when(F.col("deep"), F.struct("line", "indent"))).over(Window.partitionBy("file", "head", "row"))["indent"])
    lines = lines.withColumn("sub", F.sum((F.col("deep") & F.col("is_item")).cast("int")).over(level) - 1)
    lines = lines.withColumn("mixed", F.first(F.when(F.col("first"), F.col("is_item")), ignorenulls=True).over(part))

    wrong = (
        F.when(F.col("open"), "open quote")
        .when(F.col("top") & F.col("is_item"), "list outside a section")
        .when(~F.col("head_top"), "indented before the first section")
        .when(F.col("pair") & (F.col("k") == ""), "empty key")
        .when(~F.col("pair") & ~F.col("is_item"), "no colon")
        .when(F.col("is_item") & ~F.col("pair") & F.col("rest").contains(":") & ~F.col("rest").rlike("^['\"]"), "colon in a list's value")
        .when(F.col("v").rlike(r"^[\[{]|[\]}]$"), "collection in a line")
        .when(~F.col("top") & (F.col("head_value") != ""), "under a section with a value")
        .when(F.col("first") & (F.col("is_item") != F.col("mixed")), "list and mapping mixed")
        .when(F.col("deep") & (F.col("indent") < F.col("d1")), "indent")
        .when(F.col("deep") & (F.col("indent") != F.col("d2")), "indent")
        .when(F.col("deep") & F.col("p_item") & F.col("is_item"), "list in a list")
        .when(F.col("deep") & F.col("p_item") & F.col("p_key").isNull() & ~F.col("p_bare"), "under a value")
        .when(F.col("deep") & ~F.col("p_item") & (F.col("p_value") != ""), "under a value")
        .when(F.col("deep") & ~F.col("p_item") & ~F.col("is_item"), "mapping too deep")
    )
    # deep rows of a section's key are its list, those of an item belong to it
    item = F.when(F.col("deep") & ~F.col("p_item"), F.col("sub")).when(F.col("first") & F.col("is_item"), F.col("item")).when(F.col("deep"), F.col("item"))
    key = F.when(F.col("deep") & ~F.col("p_item"), F.col("p_key")).when(~F.col("top"), F.col("k"))
    value, quoted = _scalar(F.col("v"))
    own = F.when(~F.col("top") & ~F.coalesce("p_item", F.lit(False)), F.col("row"))
    out = lines.select(
        "file", "line", "head", own.alias("own"), F.coalesce("section", F.lit("")).alias("section"), item.cast("int").alias("item"), key.alias("key"),
        F.when(wrong.isNull(), value).alias("value"), quoted.alias("quoted"), wrong.alias("error"),
    )
    # of a section given twice the later one counts, and so it is with keys
    out = out.withColumn("last", F.max("head").over(Window.partitionBy("file", "section"))).filter("head = last or error is not null")
    out = out.withColumn("last", F.max("own").over(Window.partitionBy("file", "section", "key"))).filter("own is null or own = last or error is not null")
    later = Window.partitionBy("file", "section", "item", "key").orderBy(F.desc("line"))
    return out.withColumn("n", F.row_number().over(later)).filter("n = 1 or error is not null").select(*[c.split()[0] for c in ENTRY.split(", ")])


def json_entries(files: DataFrame) -> DataFrame:
    """The same of JSON objects; lines are 1 throughout."""
    anything = F.from_json("text", "map<string,string>")
    d = files.select("file", anything.alias("m"))
    bad = d.filter("m is null").select("file", F.lit("").alias("section"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit("no JSON object").alias("error"))
    none = F.lit(None).cast("string")
    s = d.select("file", F.explode("m").alias("section", "v"))
    is_map, is_list = F.col("v").startswith("{"), F.col("v").startswith("[")
    single = s.filter(~is_map & ~is_list | F.col("v").isNull()).select("file", "section", F.lit(None).cast("int").alias("item"), none.alias("key"), F.col("v").alias("value"), none.alias("error"))
    pairs = s.filter(is_map).select("file", "section", F.explode(F.from_json("v", "map<string,string>")).alias("key", "v"))
    keyed = pairs.filter(~F.col("v").startswith("[") | F.col("v").isNull()).select("file", "section", F.lit(None).cast("int").alias("item"), "key", F.col("v").alias("value"), none.alias("error"))
    lists = pairs.filter(F.col("v").startswith("[")).select("file", "section", "key", F.posexplode(F.from_json("v", "array<string>")).alias("item", "value")).select("file", "section", "item", "key", "value", none.alias("error"))
    items = s.filter(is_list).select("file", "section", F.posexplode(F.from_json("v", "array<string>")).alias("item", "v"))
    plain = items.filter(~F.col("v").startswith("{")).select("file", "section", "item", none.alias("key"), F.col("v").alias("value"), none.alias("error"))
    maps = items.filter(F.col("v").startswith("{")).select("file", "section", "item", F.explode(F.from_json("v", "map<string,string>")).alias("key", "value")).select("file", "section", "item", "key", "value", none.alias("error"))
    every = reduce(DataFrame.unionByName, [bad, single, keyed, lists, plain, maps])
    return every.select("file", F.lit(1).alias("line"), "section", "item", "key", "value", F.lit(False).alias("quoted"), "error")


def entries(files: DataFrame) -> DataFrame:
    """Entries of YAML and JSON files, told by their names."""
    as_json = F.lower("file").endswith(".json")
    return yaml_entries(files.filter(~as_json)).unionByName(json_entries(files.filter(as_json)))


def number(value: Column, quoted: Column) -> Column:
    """The value as a number: digits, or true and false without quotes; null for anything else."""
    flag = F.when(~quoted & (F.lower(value) == "true"), 1.0).when(~quoted & (F.lower(value) == "false"), 0.0)
    return F.coalesce(flag, F.when(F.trim(value).rlike(NUMBER), F.trim(value).try_cast("double")))


def truthy(value: Column, quoted: Column) -> Column:
    """Whether a value is set: not missing, empty, false or zero."""
    zero = ~quoted & ((F.lower(value) == "false") | F.coalesce(number(value, quoted) == 0, F.lit(False)))
    return value.isNotNull() & (value != "") & ~zero


def factors(lines: DataFrame) -> DataFrame:
    """(file, item, line, name, weight, valid): a row a factor of a file; a weight not given is 1."""
    name = F.col("key") == "name"
    weight = number(F.col("value"), F.col("quoted"))
    d = lines.filter("section = 'factors' and item is not null and error is null").groupBy("file", "item").agg(
        F.min("line").alias("line"), F.max(F.when(name, F.lower(F.trim("value")))).alias("name"),
        F.max(F.when(F.col("key") == "weight", weight)).alias("weight"), F.max(F.when(F.col("key") == "weight", F.col("value"))).alias("given"),
    )
    d = d.withColumn("weight", F.when(F.col("given").isNull(), 1.0).otherwise(F.col("weight")))
    return d.withColumn("valid", F.coalesce(F.col("weight") >= 0, F.lit(False)) & (F.col("weight") < float("inf"))).drop("given")


def problems(files: DataFrame, lines: DataFrame, known: list[str]) -> DataFrame:
    """(file, line, code, detail, severity) of ``entries``; ``known`` are the factors that there are.

    ``line`` is null for what is missing from a file as a whole.
    """
    nowhere, line = F.lit(None).cast("int"), F.col("line")
    value, quoted, section = F.col("value"), F.col("quoted"), F.col("section")
    good, single, bare = F.col("error").isNull(), F.col("item").isNull(), F.col("key").isNull()
    at = lambda s, k: good & (section == s) & (F.col("key") == k) & single

    def flagged(rows: DataFrame, checks: list[tuple]) -> DataFrame:
        """One pass over rows of files, whatever the number of checks: (condition, code, detail, severity, line)."""
        text = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
        flags = [F.when(F.coalesce(c, F.lit(False)), F.struct(n.alias("line"), text(code).alias("code"), text(detail).cast("string").alias("detail"), F.lit(severity).alias("severity"))) for c, code, detail, severity, n in checks]
        return rows.select("file", F.explode(F.array_compact(F.array(*flags))).alias("x")).select("file", "x.*")

    # single lines
    key = F.lower(F.coalesce("key", "section"))
    ahead = key.isin("allow_lookahead", "lookahead") & truthy(value, quoted) | key.isin("no_lookahead", "no_lookahead_preserved") & ~quoted & (F.lower(value) == "false")
    strange = reduce(lambda a, b: a | b, [(section == s) & ~F.col("key").isin(keys) for s, keys in SECTIONS.items()])
    method, symbol = F.lower(F.trim(value)), F.upper(F.trim(value))
    num = number(value, quoted)
    off = F.lit(False)
    for s, k, low, low_in, high, high_in, whole_only in LIMITS:
        bad = num.isNull() | (F.abs(num) == float("inf"))
        if low is not None:
            bad = bad | (num < low if low_in else num <= low)
        if high is not None:
            bad = bad | (num > high if high_in else num >= high)
        if whole_only:
            bad = bad | (num != F.floor(num))
        off = off | F.coalesce(at(s, k) & value.isNotNull() & bad, F.lit(False))
    by_line = flagged(lines, [
        (~good, "UNREADABLE_LINE", F.col("error"), ERROR, line),
        (good & ahead, "NO_LOOKAHEAD_OVERRIDE_NOT_ALLOWED", None, ERROR, line),
        (good & ~bare & strange, "WARN_UNSUPPORTED_FIELD", F.concat_ws(".", "section", "key"), WARNING, line),
        (good & bare & single & ~section.isin(*REQUIRED, "tags", *SECTIONS), "WARN_UNSUPPORTED_FIELD", F.concat(F.lit("top_level."), "section"), WARNING, line),
        (good & (section == "universe") & (F.col("key") == "symbols") & (symbol != "") & ~symbol.rlike(SYMBOL), "INVALID_SYMBOL", symbol, ERROR, line),
        (at("portfolio", "method") & truthy(value, quoted) & ~method.isin(METHODS), "UNSUPPORTED_PORTFOLIO_METHOD", method, ERROR, line),
        (good & (section == "execution") & F.col("key").isin("live_trading", "broker") & truthy(value, quoted), "LIVE_TRADING_NOT_SUPPORTED", None, ERROR, line),
        (off, F.concat(F.lit("INVALID_"), F.upper("key")), value, ERROR, line),
    ])

    # factors
    f, name = factors(lines), F.col("name")
    named = F.coalesce(name != "", F.lit(False))
    again = F.row_number().over(Window.partitionBy("file", "name").orderBy("item"))
    by_factor = flagged(f.withColumn("again", again), [
        (~named, "FACTOR_MISSING_NAME", None, ERROR, line),
        (named & ~name.isin(known), "UNSUPPORTED_FACTOR", name, ERROR, line),
        (named & ~F.col("valid"), "INVALID_FACTOR_WEIGHT", name, ERROR, line),
        (named & (F.col("again") > 1), "DUPLICATE_FACTOR", name, ERROR, line),
    ])

    # whole files: a row a file
    has = lambda s: F.coalesce(F.max(F.when(good & (section == s) & bare & single, F.trim(value) != "")), F.lit(False))
    pick = lambda s, k, c: F.max(F.when(at(s, k), c))
    listed = lambda s, k: F.count(F.when(good & (section == s) & (F.col("key") == k) & F.when(single, truthy(value, quoted)).otherwise(F.trim(value) != ""), 1))
    facts = lines.groupBy("file").agg(
        *[has(s).alias(s) for s in REQUIRED], pick("universe", "type", value).alias("kind"), pick("universe", "type", line).alias("kind_line"), listed("universe", "symbols").alias("n_symbols"),
        pick("regime", "enabled", truthy(value, quoted)).alias("enabled"), pick("regime", "enabled", line).alias("enabled_line"), listed("regime", "preferred_regimes").alias("n_preferred"),
    )
    weights = f.groupBy("file").agg(F.count("*").alias("n_factors"), F.coalesce(F.sum(F.when(F.col("valid") & named, F.col("weight"))), F.lit(0.0)).alias("total"))
    facts = files.select("file").distinct().join(facts, "file", "left").join(weights, "file", "left")
    kind, total, n_factors = F.col("kind"), F.col("total"), F.coalesce("n_factors", F.lit(0))
    by_file = flagged(facts, [
        *[(~F.coalesce(F.col(s), F.lit(False)), f"MISSING_{s.upper()}", None, ERROR, nowhere) for s in REQUIRED],
        (n_factors == 0, "MISSING_FACTORS", None, ERROR, nowhere),
        ((n_factors > 0) & (total <= 0), "FACTOR_WEIGHTS_SUM_TO_ZERO", None, ERROR, nowhere),
        ((total > 0) & (F.abs(total - 1) > 1e-9), "WARN_FACTOR_WEIGHTS_NORMALIZED", None, WARNING, nowhere),
        (~kind.isin(UNIVERSES), "UNSUPPORTED_UNIVERSE_TYPE", kind, ERROR, F.col("kind_line")),
        ((kind == "custom") & (F.col("n_symbols") == 0), "CUSTOM_UNIVERSE_REQUIRES_SYMBOLS", None, ERROR, F.col("kind_line")),
        (F.coalesce(kind == "default", F.lit(True)) & (F.coalesce("n_symbols", F.lit(0)) == 0), "WARN_DEFAULT_UNIVERSE_USED", None, WARNING, F.col("kind_line")),
        (F.col("enabled") & (F.col("n_preferred") == 0), "WARN_REGIME_ENABLED_WITHOUT_PREFERRED_REGIMES", None, WARNING, F.col("enabled_line")),
    ])
    return by_line.unionByName(by_factor).unionByName(by_file)
