"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by compression policy.
MEDIA = "braw prores mxf r3d wav mp4 mov m4v avi mkv aac aif aiff bwf gpr arw dng cr2 cr3 nef".split()
EDITORS = "prproj drp fcpxmld avp veg aep nle".split()
TEXTISH = "json xml csv txt md yaml yml toml html css js ts edl srt fcpxml otio aar lutt".split()

# What each role may do.
ROLES = {
    "owner": "read write-files organize-bins lock-file lock-timeline edit-timeline color-grade mix-audio comment manage-review manage-members manage-flags attach-root detach-root verify snapshot restore view-presence",
    "lead-editor": "read write-files organize-bins lock-file lock-timeline edit-timeline color-grade mix-audio comment manage-review manage-flags attach-root detach-root verify snapshot view-presence",
    "editor": "read write-files organize-bins lock-file edit-timeline comment manage-review attach-root detach-root verify snapshot view-presence",
    "assistant": "read write-files organize-bins comment attach-root verify snapshot view-presence",
    "colorist": "read write-files lock-file color-grade comment attach-root verify view-presence",
    "sound-designer": "read write-files lock-file mix-audio comment attach-root verify view-presence",
    "reviewer": "read comment view-presence",
}

# Spellings of roles and of note states.
ROLE_WORDS = {"owner": "owner", "lead-editor": "lead-editor", "lead": "lead-editor", "editor": "editor", "assistant": "assistant", "assist": "assistant", "colorist": "colorist", "color": "colorist", "sound-designer": "sound-designer", "sound": "sound-designer", "reviewer": "reviewer", "client": "reviewer"}
STATUS_WORDS = {"OPEN": "OPEN", "RESOLVED": "RESOLVED", "DONE": "RESOLVED", "FIXED": "RESOLVED", "ADDRESSED": "RESOLVED", "REJECTED": "REJECTED", "WONTFIX": "REJECTED", "WONT-FIX": "REJECTED", "DISMISSED": "REJECTED"}

# Names that Windows reserves, and characters that it refuses.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
REFUSED = r'[<>:"|?*/\\\\]'

MAX_PATH, MAX_KEY, MAX_SLUG, MAX_EXTENSION = 4096, 256, 48, 12
DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def request_id(*fields: Column | str) -> Column:
    """A content-derived request id: 'req-' and the digest of the fields joined by line ends."""
    return F.concat(F.lit("req-"), F.sha2(F.concat_ws("\n", *(_col(f).cast("string") for f in fields)), 256))


def valid_path(path: Column | str) -> Column:
    """Whether a stored relative path is safe: no empty, dot or traversal part, no drive, no control character, bounded length."""
    p = _col(path)
    parts = F.split(p, "/", -1)
    bad = F.exists(parts, lambda x: x.isin("", ".", ".."))
    return (F.octet_length(p).between(1, MAX_PATH)) & ~p.rlike(r"[\x00-\x1f\x7f\\]") & ~p.rlike(r"^/") & ~p.rlike(r"^[A-Za-z]:") & ~bad


def valid_key(key: Column | str) -> Column:
    k = _col(key)
    return F.octet_length(k).between(1, MAX_KEY) & ~k.rlike(r"[\x00-\x1f\x7f/\\]")


def ignored(path: Column | str) -> Column:
    """Whether a scan skips the path by its last part."""
    name = F.substring_index(_col(path), "/", -1)
    return name.isin(".DS_Store", "Thumbs.db", "desktop.ini") | name.startswith("._")


def windows_name(name: Column | str) -> Column:
    n = _col(name)
    return F.when(F.upper(F.substring_index(n, ".", 1)).isin(RESERVED), F.concat(F.lit("#"), n)).otherwise(n)


def extension(path: Column | str) -> Column:
    return F.substring_index(F.lower(_col(path)), ".", -1)


def compression(path: Column | str) -> Column:
    """none, zstd3 or zstd_dict by extension; unknown ones are stored as they are."""
    e = extension(path)
    return F.when(e.isin(MEDIA), "none").when(e.isin(EDITORS), "zstd_dict").when(e.isin(TEXTISH), "zstd3").otherwise("none")


def conflict_copy(name: Column | str, device: Column | str, date: Column | str) -> Column:
    """The name of a losing copy; a short extension stays at the end and refused characters become underscores."""
    n = _col(name)
    has = n.rlike(rf"\.[^./]{{1,{MAX_EXTENSION}}}$") & (F.octet_length(F.substring_index(n, ".", -1)) <= MAX_EXTENSION)
    safe = lambda c: F.regexp_replace(c, REFUSED, "_")
    stem = F.when(has, F.regexp_replace(n, r"\.[^.]*$", "")).otherwise(n)
    base = F.concat(safe(stem), F.lit(" (conflict — "), safe(_col(device)), F.lit(" — "), safe(_col(date)), F.lit(")"))
    return F.when(has, F.concat(base, F.lit("."), safe(F.substring_index(n, ".", -1)))).otherwise(base)


def slug(name: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(F.trim(_col(name)), r"[^A-Za-z0-9_-]", "-")), r"^-+|-+$", "")
    return F.when(s == "", "project").otherwise(F.substring(s, 1, MAX_SLUG))


def day(ms: Column | str) -> Column:
    """YYYY-MM-DD in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_col(ms) / DAY_MS).cast("int")).cast("string")


def timecode(frame: Column | str, rate: Column | str) -> Column:
    """HH:MM:SS:FF of a frame; negative ones get a sign, and without a positive rate the frame itself is given."""
    f, r = _col(frame), _col(rate)
    a = F.abs(f)
    second = F.call_function("div", a, F.nullif(r, F.lit(0)))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    hours = F.call_function("div", second, F.lit(3600))
    text = F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.call_function("div", second, F.lit(60)) % 60), two(second % 60), two(a % F.nullif(r, F.lit(0))))
    return F.when(r <= 0, f.cast("string")).otherwise(F.concat(F.when(f < 0, "-").otherwise(""), text))


def to_frames(num: Column, den: Column, rate: Column) -> Column:
    """The frame that num/den seconds fall in at a whole rate: a floor, also below zero."""
    return F.call_function("div", num * rate - F.pmod(num * rate, den), den)


def range_end(start: Column, length: Column, rate: Column) -> Column:
    """The seconds, as 'n/d' in least terms, at which a range of frames ends."""
    end = start + length
    common = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.abs(end).alias("a"), rate.cast("long").alias("b")), lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.nullif(s.b, F.lit(0))).alias("b"))))
    return F.concat(F.call_function("div", end, common.a).cast("string"), F.lit("/"), F.call_function("div", rate.cast("long"), common.a).cast("string"))


def fingerprint(*fields: Column | str) -> Column:
    """The fields of a clip that make its content, joined by bars; a missing one is empty."""
    return F.concat_ws("|", *(F.coalesce(_col(f).cast("string"), F.lit("")) for f in fields))


def hex_text(data: Column | str) -> Column:
    return F.lower(F.hex(_col(data)))


def shard(digest: Column | str) -> Column:
    """The folder of a digest: its first two hexadecimal digits."""
    return F.substring(_col(digest), 1, 2)


def namespace(owner: Column | str, name: Column | str) -> Column:
    return F.concat(_col(owner), F.lit("#"), _col(name))


def split_namespace(text: Column | str) -> tuple[Column, Column]:
    """(owner, name) at the first '#'; without one there is no owner."""
    t = _col(text)
    at = F.instr(t, "#")
    return F.when(at > 0, F.substring(t, F.lit(1), at - 1)), F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise(t)


def link_expired(expires_at: Column | str, now_ms: int) -> Column:
    """A guest link without an end (0) never expires."""
    e = _col(expires_at)
    return (e > 0) & (F.lit(now_ms) >= e)


def pin_text(x: Column | str) -> Column:
    """A pin's coordinate with three decimals."""
    return F.format_string("%.3f", _col(x).cast("double"))


def csv_field(text: Column | str) -> Column:
    """A field of a CSV line: quoted where it holds a comma, a quote or a line end."""
    t = _col(text)
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def audit_id(*fields: Column | str) -> Column:
    """The first 16 hexadecimal digits of the digest of an audit record's fields."""
    return F.substring(F.sha2(F.concat_ws("\n", *(_col(f).cast("string") for f in fields)), 256), 1, 16)


def rational_compare(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """-1, 0 or 1 for n1/d1 against n2/d2 by exact cross products (positive denominators)."""
    wide = "decimal(19,0)"
    return F.signum(n1.cast(wide) * d2.cast(wide) - n2.cast(wide) * d1.cast(wide)).cast("int")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of at least two bytes."""
    return F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def search_score(query: list[str], path: Column | str, name: Column | str | None = None) -> Column:
    """Relevance of a path, and of a name that is its last part unless given: 10 for a whole token, 6 for a prefix, 4 for a part of the name, 2 for a part of the path; 5 more if all occur."""
    p = F.lower(_col(path))
    name, hay = F.substring_index(p, "/", -1) if name is None else F.lower(_col(name)), tokens(path)
    total = F.lit(0)

    def one(q: str) -> Column:
        return F.when(F.array_contains(hay, q), 10).when(F.exists(hay, lambda t: t.startswith(q)), 6).when(name.contains(q), 4).when(p.contains(q), 2).otherwise(0)

    for q in query:
        total = total + one(q)
    every = F.lit(True)
    for q in query:
        every = every & (p.contains(q) | name.contains(q))
    return total + F.when((total > 0) & every, 5).otherwise(0)


def synonym(text: Column | str, words: dict[str, str], upper: bool) -> Column:
    """A word's canonical form by a fixed table, or null."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    t = F.trim(_col(text))
    return F.try_element_at(table, F.upper(t) if upper else F.lower(t))


def badge(state: Column | str) -> Column:
    s = _col(state)
    return F.when(s == "conflict", "conflict").when(s == "synced", "synced").otherwise("syncing")


def overlay(state: Column | str) -> Column:
    """The icon of a file, or null: placeholders are being fetched, clean files are in step."""
    s = _col(state)
    return F.when(s == "placeholder", "fetching").when(s == "clean", "synced").when(s.isin("conflict", "synced", "pinned"), s)


def native_collab(path: Column | str) -> Column:
    return F.exists(F.split(_col(path), r"[/\\]"), lambda c: c.endswith(".prodsys"))


def is_timeline(path: Column | str) -> Column:
    return _col(path).rlike(r"(?i)\.(otio|fcpxml)$")


def backoff_bound(n: Column | str) -> Column:
    """The bound of a jittered wait in milliseconds."""
    return F.least(F.lit(30_000), F.lit(100) * F.pow(F.lit(2), F.least(_col(n), F.lit(9)))).cast("long")


def decide(rows: DataFrame) -> DataFrame:
    """(role, permission) rows with ``allowed``; a role that is not listed is an editor."""
    spark = rows.sparkSession
    matrix = spark.createDataFrame([(r, p, True) for r, ps in ROLES.items() for p in ps.split()], "_role string, permission string, allowed boolean")
    known = F.when(F.col("role").isin(list(ROLES)), F.col("role")).otherwise("editor")
    joined = rows.withColumn("_role", known).join(F.broadcast(matrix), ["_role", "permission"], "left")  # a fixed matrix
    return joined.select(*rows.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))


def flags(tenants: DataFrame, stored: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(tenant, flag, value, enabled): the stored value or the default; enabled unless it reads false."""
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.lit(v).alias("fallback")) for k, v in defaults.items())))
    rows = tenants.select("tenant", names.alias("d")).select("tenant", "d.*").join(stored, ["tenant", "flag"], "left")
    value = F.coalesce("value", "fallback", F.lit(""))
    return rows.select("tenant", "flag", value.alias("value"), (F.lower(value) != "false").alias("enabled"))
