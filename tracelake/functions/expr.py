"""Scalar functions as Column expressions; none is a Python UDF."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats that lenient parsing tries in turn, placeholders, characters that start a spreadsheet formula.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy", "yyyy-MM-dd")
PLACEHOLDERS = ("-", "N/A", "n/a", "(null)")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TURNED = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
# What redaction replaces, in this order.
LITERALS = (
    (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "[ipv4]"),
    (r"\[(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}\]", "[ipv6]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[email]"),
)
PATHS = (
    (r"(?i)%(?:userprofile|homedrive|homepath|username|localappdata|appdata|temp)%", "[env_redacted]"),
    (r"""\\\\[^\\/:?\s"<>|]+(?:\\[^\\/:?\s"<>|]+)+""", "[path_redacted]"),
    (r"""[A-Za-z]:(?:\\[^\\/:*?"<>|\r\n]+)+""", "[path_redacted]"),
    (r"""[A-Za-z]:(?:/[^/:*?"<>|\r\n]+)+""", "[path_redacted]"),
    (r"""(?i)/(?:home|Users)/[^/:\s"]+(?:/[^/:\s"]+)*""", "[path_redacted]"),
)
# The same with the same matches, in time linear in the text and without recursion by path segment: possessive where
# nothing is given back, and an address tried once for each run of its characters.
SEARCHED_LITERALS = (
    *LITERALS[:2],
    (r"(?:\G|(?<![A-Za-z0-9._%+\-]))((?:\B[A-Za-z0-9._%+\-])*+)\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "$1[email]"),
)
SEARCHED_PATHS = (
    PATHS[0],
    (r"""\\\\[^\\/:?\s"<>|]++(?:\\[^\\/:?\s"<>|]++)++""", "[path_redacted]"),
    (r"""[A-Za-z]:(?:\\[^\\/:*?"<>|\r\n]++)++""", "[path_redacted]"),
    (r"""[A-Za-z]:(?:/[^/:*?"<>|\r\n]++)++""", "[path_redacted]"),
    (r"""(?i)/(?:home|Users)/[^/:\s"]++(?:/[^/:\s"]++)*+""", "[path_redacted]"),
)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row however often body names it; a plain column used within a lambda may be inlined there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def first_set(*cs: Column) -> Column:
    """First value that is not blank, else ''."""
    return F.coalesce(*(F.when(~blank(c), F.trim(c)) for c in cs), F.lit(""))


def parse_time(s: Column, zone: Column | str = "UTC") -> Column:
    """Lenient time; null if it has none. A time without an offset is read in the host's zone."""
    s = F.trim(s)
    # A format that cannot fit, for want of its signs, is not tried: a failed try is dear.
    fits = lambda f: reduce(lambda a, b: a & b, (F.lower(s).contains(c.lower()) for c in ("T", "-", "/", ":", " ") if c in re.sub(r"\[.*?\]", "", f)))
    t = F.when(s.rlike("[0-9]"), F.coalesce(*(F.when(fits(f), F.try_to_timestamp(s, F.lit(f))) for f in TIME_FORMATS)))
    local = ~s.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$")
    return F.to_utc_timestamp(t, F.when(local, zone).otherwise("UTC"))


def usable(t: Column) -> Column:
    """Times of pivots: after 1980."""
    return F.coalesce(F.year(t) > 1980, F.lit(False))


def usable_event(t: Column) -> Column:
    """Times of events and the timeline: 1980 counts too."""
    return F.coalesce(F.year(t) >= 1980, F.lit(False))


def export_time(t: Column) -> Column:
    """Times outside 1970 to 2099 become the epoch."""
    return F.when(F.year(t).between(1970, 2099), t).otherwise(F.timestamp_seconds(F.lit(0)))


def iso(t: Column) -> Column:
    return F.when(usable(t), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")


def bucket_start(t: Column, minutes: int) -> Column:
    """Hour plus whole buckets of its minutes: sizes that do not divide an hour leave a short last bucket."""
    return F.date_trunc("HOUR", t) + F.make_interval(mins=(F.floor(F.minute(t) / minutes) * minutes).cast("int"))


def bucket_end(start: Column, minutes: int) -> Column:
    return start + F.make_interval(mins=F.lit(minutes))


def filetime(n: Column) -> Column:
    return F.timestamp_micros((n.cast("long") / 10).cast("long") - 11_644_473_600_000_000)


def webkit(n: Column) -> Column:
    return F.timestamp_micros(n.cast("long") - 11_644_473_600_000_000)


def epoch(n: Column) -> Column:
    """By size: 100 ns since 1601, microseconds since 1601, microseconds or seconds since 1970."""
    v = n.cast("long")
    return F.when(v > 100_000_000_000_000_000, filetime(v)).when(v > 10_000_000_000_000_000, webkit(v)).when(v > 100_000_000_000, F.timestamp_micros(v)).when(v > 0, F.timestamp_seconds(v))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def neutral(c: Column) -> Column:
    """A leading formula character gets an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def single_line(c: Column) -> Column:
    return F.trim(F.translate(text(c), "\r\n\t", "   "))


def placeholder(c: Column) -> Column:
    """Single line; placeholders become ''."""
    s = single_line(c)
    return F.when(s.isin(*PLACEHOLDERS), "").otherwise(s)


def first_of_each(entries: Column) -> Column:
    """A map of structs (k, v); of equal keys the first counts."""

    def kept(e):
        return let(F.transform(e, lambda x: x["k"]), lambda keys: F.filter(e, lambda x, i: F.array_position(keys, x["k"]) == i + 1))

    return F.map_from_entries(let(entries, kept))


def pairs(c: Column) -> Column:
    """`k=v | k=v` as a map by normalised key; of equal keys the first counts."""
    items = F.filter(F.split(text(c), r" \| "), lambda x: F.instr(x, "=") > 1)
    value = lambda x: F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x)))
    return first_of_each(F.transform(items, lambda x: F.struct(plain_key(F.substring_index(x, "=", 1)).alias("k"), value(x).alias("v"))))


def plain_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def lookup(m: Column, *names: str) -> Column:
    """First value under any of the names that is not blank, else ''."""
    return first_set(*(F.try_element_at(m, plain_key(F.lit(n))) for n in names))


def event_xml(c: Column) -> Column:
    """Event XML as a map by normalised name: named Data elements, unnamed ones as Data1, Data2, ..., and the leaves of UserData; of equal names the first counts."""
    plain = lambda v: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")), v)
    data = F.regexp_extract_all(text(c), F.lit(r"<Data(?:\s+Name=[\"'][^\"']*[\"'])?\s*(?:/>|>[^<]*</Data>)"), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"Name=[\"']([^\"']*)[\"']", 1)
    value = lambda x: F.trim(plain(F.regexp_extract(x, r">([^<]*)</", 1)))
    pair = lambda k, v: F.struct(plain_key(k).alias("k"), v.alias("v"))
    named = F.transform(F.filter(data, lambda x: name(x) != ""), lambda x: pair(name(x), value(x)))
    bare = F.transform(F.filter(data, lambda x: name(x) == ""), lambda x, i: pair(F.concat(F.lit("Data"), (i + 1).cast("string")), value(x)))
    user = F.regexp_extract(text(c), r"(?s)<UserData[^>]*>(.*)</UserData>", 1)
    leaves = F.transform(F.regexp_extract_all(user, F.lit(r"<([A-Za-z][\w.]*)(?:\s[^>]*)?>[^<]+</\1>"), F.lit(0)), lambda x: pair(F.regexp_extract(x, r"^<([A-Za-z][\w.]*)", 1), value(x)))
    return first_of_each(F.concat(named, bare, leaves))


def flatten(m: Column, most: int = 40, value: int = 300, total: int = 4000) -> Column:
    """Map to `k=v | k=v`, within limits."""
    parts = F.transform(F.slice(F.map_entries(m), 1, most), lambda e: F.concat(e["key"], F.lit("="), truncate(F.replace(single_line(e["value"]), F.lit("|"), F.lit("/")), value)))
    return truncate(F.array_join(parts, " | "), total)


def is_ipv4(c: Column) -> Column:
    return F.trim(c).rlike(IPV4)


def remote_refs(c: Column) -> Column:
    """References that a UNC path or http(s) address names: RemoteIP or Workstation, and ShareName."""
    s = F.trim(text(c))
    unc = s.startswith("\\\\")
    server = F.when(unc, F.regexp_extract(s, r"^\\\\([^\\]*)", 1)).when(s.rlike("(?i)^https?://"), F.regexp_extract(s, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise("")
    share = F.when(unc, F.regexp_extract(s, r"^\\\\[^\\]+\\([^\\]*)", 1)).otherwise("")
    return F.array(
        F.struct(F.lit("RemoteIP").alias("type"), F.when(is_ipv4(server), server).otherwise("").alias("value")),
        F.struct(F.lit("Workstation").alias("type"), F.when(unc & ~is_ipv4(server), server).otherwise("").alias("value")),
        F.struct(F.lit("ShareName").alias("type"), share.alias("value")),
    )


def binary_path(c: Column) -> Column:
    """Path of the program in a command string: quoted, on a drive, or UNC."""
    s = F.trim(text(c))
    return first_set(
        F.when(s.startswith('"'), F.regexp_extract(s, r'^"([^"]+)"', 1)),
        F.regexp_extract(s, r"(?i)^[A-Z]:\\.+?\.(?:exe|dll|sys|com|bat|cmd|ps1|vbs|js)\b", 0),
        F.regexp_extract(s, r"(?i)^\\\\.+?\.(?:exe|dll|sys|com|bat|cmd|ps1|vbs|js)\b", 0),
    )


def path_in(c: Column) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?i)([A-Z]:\\[^\s\"';]+)", 1))


def account_in(c: Column) -> Column:
    """The first account named in a text, else ''."""
    part = lambda n: F.regexp_extract(text(c), r"([A-Za-z0-9.\-_]+)\\([A-Za-z0-9.\-_$]+)", n)
    return account(part(1), part(2))


def account(domain: Column, user: Column) -> Column:
    d, u = placeholder(domain), placeholder(user)
    return F.when(blank(u), "").when(blank(d), u).otherwise(F.concat(d, F.lit("\\"), u))


def rot13(c: Column) -> Column:
    return F.translate(c, ALPHABET, TURNED)


def indicator(command: Column, name: Column) -> Column:
    return F.left(F.lower(first_set(command, name)), F.lit(120))


def base_name(c: Column) -> Column:
    """After the last separator; '' if one ends it."""
    return F.regexp_extract(F.trim(text(c)), r"[^\\/]*$", 0)


def some(values: Column, n: int = 5, sep: str = " | ") -> Column:
    """First n values, then `+k more`."""
    shown = F.array_join(F.slice(values, 1, n), sep)
    return F.when(F.size(values) > n, F.concat(shown, F.lit(f"{sep}+"), (F.size(values) - n).cast("string"), F.lit(" more"))).otherwise(shown)


def summary(refs: Column, n: int = 5) -> Column:
    return some(F.transform(refs, lambda r: F.concat(r["type"], F.lit("="), r["value"])), n)


def service_host(c: Column) -> Column:
    """Host part of a service principal: after the first slash, before `@`, `/` or `:`."""
    s = F.trim(text(c))
    return F.when(F.instr(s, "/") > 0, F.regexp_extract(s, r"^[^/]*/([^/@:\s]*)", 1)).otherwise("")


def tags(c: Column) -> Column:
    """Distinct tags, case ignored, first spelling kept."""
    return distinct_ci(F.filter(F.transform(F.split(text(c), "[,;\r\n]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def distinct_ci(a: Column) -> Column:
    low = F.transform(a, lambda x: F.lower(x))
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def is_hash(c: Column) -> Column:
    return c.rlike("^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{64})$")


def app_path(app_id: Column) -> Column:
    return F.when(F.instr(app_id, ":\\") > 0, app_id).otherwise("")


def usn_action(reason: Column) -> Column:
    r = F.upper(text(reason))
    has = r.contains
    return F.when(has("FILE_CREATE"), "Created").when(has("FILE_DELETE"), "Deleted").when(has("RENAME_"), "Renamed").when(has("DATA_OVERWRITE") | has("DATA_EXTEND") | has("DATA_TRUNCATION") | has("BASIC_INFO_CHANGE") | has("SECURITY_CHANGE"), "Modified").when(has("CLOSE"), "Closed").otherwise("Changed")


# Path tests of the hunt rules. The marks they look for.
def _any(s: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(m) for m in marks])


def user_writable(c: Column) -> Column:
    return _any(F.lower(F.trim(text(c))), ("\\users\\", "\\appdata\\", "\\temp\\", "\\public\\", "\\programdata\\"))


def is_script(c: Column) -> Column:
    return F.lower(F.trim(text(c))).rlike(r"\.(?:cmd|bat|ps1|vbs|js)$")


def is_interpreter(c: Column) -> Column:
    return F.lower(F.trim(text(c))).rlike(r"\\(?:cmd|powershell|pwsh|wscript|cscript|rundll32|regsvr32|mshta)\.exe$")


def suspicious_program(c: Column) -> Column:
    up = F.upper(F.trim(text(c)))
    return up.rlike(r"\.(?:EXE|DLL|SCR|COM|BAT|CMD|PS1|VBS|JS)$") & _any(up, ("\\TEMP\\", "\\APPDATA\\", "\\DOWNLOADS\\", "\\$RECYCLE.BIN\\", "\\PROGRAMDATA\\", "\\USERS\\PUBLIC\\", "\\PERFLOGS\\"))


def unquoted_service(c: Column) -> Column:
    s = F.trim(text(c))
    return ~s.startswith('"') & F.coalesce(F.regexp_extract(F.lower(s), r"^(.*?\.exe)", 1).contains(" "), F.lit(False))


def admin_share(c: Column) -> Column:
    return F.upper(F.trim(text(c))).isin("ADMIN$", "IPC$", "C$", "D$")


def suspicious_arguments(c: Column) -> Column:
    return _any(F.lower(text(c)), (" -enc", " -encodedcommand", " /c ", " -nop", "\\users\\", "\\temp\\", "\\public\\"))


def redact(c: Column, paths: bool = False) -> Column:
    """Network literals masked, and paths too, in values of any length."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], F.lit(r[1])), SEARCHED_LITERALS + (SEARCHED_PATHS if paths else ()), text(c))


def mask_principal(c: Column) -> Column:
    t = F.trim(text(c))
    drive = t.rlike(r"^[A-Za-z]:[\\/]")
    return F.when(~drive & t.rlike(r"^[^\\]+\\."), "[user_redacted]").otherwise(redact(c, True))
