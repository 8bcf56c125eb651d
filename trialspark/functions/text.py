"""Text, key-value and URL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters that count as white space.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+"


def sanitize_cell(x: Column, limit: int = 240) -> Column:
    """One line of text, cut at `limit` characters with '...'."""
    one = F.regexp_replace(F.regexp_replace(x, SPACE, " "), r"^ | $", "")
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 3), F.lit("..."))).otherwise(one)


def safe_double(x: Column) -> Column:
    """Number from text; '', 'N/A', 'None' and other text give null."""
    return x.try_cast("double")


def kv_entries(x: Column, sep: str = ";") -> Column:
    """array<struct(key, value)> of `a=b` parts; parts without '=' are skipped."""
    parts = F.filter(F.transform(F.split(x, sep), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 0)
    return F.transform(parts, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"),
        F.trim(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value")))


def option_entries(x: Column, sep: str = ":") -> Column:
    """Like kv_entries for encoder options: a bare key has the value '1'."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), sep), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"),
        F.when(F.instr(p, "=") > 0, F.trim(p.substr(F.instr(p, "=") + 1, F.length(p)))).otherwise("1").alias("value")))


def entry_value(entries: Column, key: str) -> Column:
    """Value of a key in an entry array; the last one wins, null when absent."""
    hit = F.filter(entries, lambda e: e["key"] == key)
    return F.try_element_at(hit, F.lit(-1))["value"]


def _pick_last(keys: Column, entries: Column, make) -> Column:
    """One item per key from its last entry; the entries are passed along as a value,
    so that they are built once and not once per key."""
    return F.aggregate(
        F.array(F.struct(keys.alias("k"), entries.alias("e"))), F.lit(None).cast("array<string>"),
        lambda _, x: F.transform(x["k"], lambda k: make(k, F.element_at(F.filter(x["e"], lambda e: e["key"] == k), -1)["value"])))


def entries_to_map(entries: Column) -> Column:
    """Map with the last value per key, whatever the session's map policy."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, _pick_last(keys, entries, lambda k, v: v))


def merge_options(base: Column, override: Column, sep: str = ":") -> Column:
    """Base options with overrides; base order is kept, an empty side passes through."""
    b, o = F.trim(F.coalesce(base, F.lit(""))), F.trim(F.coalesce(override, F.lit("")))
    both = F.concat(option_entries(b, sep), option_entries(o, sep))
    keys = F.array_distinct(F.transform(both, lambda e: e["key"]))
    text = F.array_join(_pick_last(keys, both, lambda k, v: F.concat(k, F.lit("="), v)), sep)
    return F.when(o == "", b).when(b == "", o).otherwise(text)


# The option columns of the training table and their types.
OPTION_COLUMNS = {"aq-mode": "int", "aq-strength": "double", "rd": "int", "ref": "int", "bframes": "int",
                  "rc-lookahead": "int", "keyint": "int", "min-keyint": "int", "scenecut": "int"}


def expand_options(df, params: str, prefix: str = ""):
    """Typed option columns from a parameter text column (integers are read through
    a float), plus the raw text of values that are no number."""
    df = df.withColumn("_opts", tidy_options(F.col(params)))
    raws = df.withColumns({f"_raw_{k}": last_option(F.col("_opts"), k) for k in OPTION_COLUMNS})
    out = {}
    for key, typ in OPTION_COLUMNS.items():
        raw = F.col(f"`_raw_{key}`")
        n = raw.try_cast("double")
        name = prefix + key.replace("-", "_")
        out[name] = n.try_cast("int") if typ == "int" else n
        out[f"{name}_raw"] = F.when(n.isNull(), raw)
    return raws.withColumns(out).drop("_opts", *[f"_raw_{k}" for k in OPTION_COLUMNS])


def tidy_options(params: Column) -> Column:
    """Option text as `:key=value:key=value:`: bare keys get the value 1, and no space stands around a key."""
    def entry(e: Column) -> Column:
        e = F.trim(e)
        at = F.instr(e, "=")
        key = F.rtrim(F.substring_index(e, "=", 1))
        return F.when(e == "", "").when(at == 0, F.concat(e, F.lit("=1"))).otherwise(F.concat(key, F.lit("="), e.substr(at + 1, F.length(e))))

    return F.concat(F.lit(":"), F.array_join(F.transform(F.split(F.coalesce(params, F.lit("")), ":"), entry), ":"), F.lit(":"))


def last_option(tidy: Column, key: str) -> Column:
    """Last value of an option in a text of tidy_options; null without it."""
    mark = f":{key}="
    return F.when(F.contains(tidy, F.lit(mark)), F.trim(F.substring_index(F.substring_index(tidy, mark, -1), ":", 1)))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_unquote(x: Column) -> Column:
    """%XX decoding only ('+' stays); malformed text is kept as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def url_video_id(url: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(url_unquote(url_path(url)), "/"), -1), r"\.mp4$", "")
    return F.when(name == "", url).otherwise(name)


def human_bytes(n: Column) -> Column:
    """B / KB / MB / GB / TB with one decimal above bytes."""
    from trialspark.functions.numbers import fixed_text
    v = n.cast("double")
    out = F.when(n.isNull(), F.lit("—")).when(v < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), start=1):
        out = out.when(v < 1024.0 ** (i + 1), F.concat(fixed_text(v / 1024.0 ** i, 1), F.lit(" " + unit)))
    return out.otherwise(F.concat(fixed_text(v / 1024.0 ** 4, 1), F.lit(" TB")))


# Names of the two rate control families.
RC_NAMES = ("RC", "CRF", "CQ")
ABR_NAMES = ("ABR", "VBR", "BITRATE", "AVG_BITRATE", "AVGBITRATE")


def codec_mode(x: Column) -> Column:
    """RC or ABR; missing text is RC, unknown names give null."""
    k = F.trim(F.upper(F.when(F.coalesce(x, F.lit("")) == "", F.lit("RC")).otherwise(x)))
    return F.when(k.isin(*RC_NAMES), "RC").when(k.isin(*ABR_NAMES), "ABR")


def log_mode(x: Column) -> Column:
    """CRF / VBR families of log rows; other names stay."""
    k = F.upper(F.coalesce(x, F.lit("")))
    return F.when(k.isin("ABR", "BITRATE"), "VBR").when(k.isin("RC", "CQ"), "CRF").otherwise(k)


def parse_bitrate(x: Column) -> Column:
    """Mbps from text with an optional k/m/g suffix; bad text gives null."""
    t = F.lower(F.trim(x))
    cut = F.left(t, F.length(t) - 1).try_cast("double")
    return (F.when(F.endswith(t, F.lit("k")), cut * (1 / 1000.0)).when(F.endswith(t, F.lit("m")), cut)
            .when(F.endswith(t, F.lit("g")), cut * 1000.0).otherwise(t.try_cast("double")))


def bitrate_text(mbps: Column) -> Column:
    from trialspark.functions.numbers import fixed_text
    return F.when(mbps >= 1.0, F.concat(fixed_text(mbps, 3), F.lit("M"))).otherwise(
        F.concat(fixed_text(F.greatest(F.lit(1.0), mbps * 1000.0), 0), F.lit("k")))


def bitrate_for_rate(source_bytes: Column, duration: Column, rate: Column) -> Column:
    """struct(bitrate, error): the -b:v text that hits a target size share."""
    mbps = rate * source_bytes * 8.0 / duration / 1_000_000.0
    err = (F.when(F.coalesce(source_bytes <= 0, F.lit(True)), "bad source size")
           .when(F.coalesce(duration <= 0, F.lit(True)), "bad duration")
           .when(~F.coalesce((rate > 0) & (rate < 1), F.lit(False)), "bad rate"))
    return F.struct(F.when(err.isNull(), bitrate_text(mbps)).alias("bitrate"), err.alias("error"))
