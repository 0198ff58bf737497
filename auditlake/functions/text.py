"""Text and identity expressions; all of them columns, none a Python function per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from auditlake.session import trimmed

# What counts as an identity.
CWES = [
    "CWE-119", "CWE-416", "CWE-476", "CWE-190", "CWE-362", "CWE-89", "CWE-78", "CWE-79", "CWE-94", "CWE-918", "CWE-862",
    "CWE-863", "CWE-915", "CWE-639", "CWE-306", "CWE-287", "CWE-307", "CWE-352", "CWE-384", "CWE-444", "CWE-807", "CWE-200",
    "CWE-319", "CWE-327", "CWE-502", "CWE-22", "CWE-434", "CWE-770", "CWE-284", "CWE-20", "CWE-840", "OTHER_UNCATEGORIZED",
]
SYSTEMIC_CWES = ["CWE-327", "CWE-319", "CWE-306", "CWE-200", "CWE-352", "CWE-384", "CWE-840", "CWE-915"]
DEPENDENCY_TYPES = ["Known Dependency Vulnerability", "Dependency Mitigation Vulnerability"]
UNKNOWN_ANCHOR = "unknown_anchor"
SIGNATURE_MAX_WORDS, SIGNATURE_MAX_CHARS = 6, 60
VERSION = r"(?<![\d.])\b(?:v|version\s*)?\d+\.\d+(?:\.\d+)?(?!\.\d)(?:-[a-zA-Z0-9.]+)?\b"
VERSION_PHRASE = r"(?i)(?:fixed\s+in|prior\s+to|before|upgrading\s+to)\s+(?:" + VERSION + r"[.,]?)"
# End of the fixed values.


def one_space(c: Column | str) -> Column:
    """Lower case, trimmed, each run of white space one blank; null stays null."""
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def cwe_key(c: Column | str) -> Column:
    """The catalogue's key, OTHER_UNCATEGORIZED for null, blank and unknown ones."""
    up = F.upper(trimmed(c))
    return F.when(up.isin(CWES), up).otherwise(F.lit("OTHER_UNCATEGORIZED"))


def signature(c: Column | str) -> Column:
    """A grouping token: lower case, quotes dropped, everything else that is no letter or digit one underscore; '' for null and blank."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "[`'\"]", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def first_signature(*candidates: Column) -> Column:
    """The first candidate's signature that is not empty, or '' if that one is too long to be a label."""
    sigs = [signature(c) for c in candidates]
    first = F.coalesce(*[F.when(s != "", s) for s in sigs], F.lit(""))
    words = F.length(first) - F.length(F.replace(first, F.lit("_"), F.lit(""))) + 1
    return F.when((words > SIGNATURE_MAX_WORDS) | (F.length(first) > SIGNATURE_MAX_CHARS), F.lit("")).otherwise(first)


def or_null(c: Column) -> Column:
    """Null for the empty text."""
    return F.when(c != "", c)


def record_id(cwe: Column, kind: Column, nodes: Column, component: Column, demand: Column, cve: Column, description: Column) -> Column:
    """The identity of a finding without one: by pattern for systemic classes, by CVE for dependencies, else by node,
    class and anchor. `cwe` must be a catalogue key."""
    named_demand = F.when(demand != UNKNOWN_ANCHOR, or_null(demand))
    systemic = cwe.isin(SYSTEMIC_CWES) & or_null(cve).isNull() & ~F.coalesce(kind.isin(DEPENDENCY_TYPES), F.lit(False))
    sig = first_signature(component, named_demand, cve, description)
    primary = F.coalesce(F.get(nodes, F.lit(0)), F.lit("general"))
    known = F.coalesce(kind == DEPENDENCY_TYPES[0], F.lit(False))
    by_pattern = F.concat_ws(":", F.lit("systemic"), cwe, or_null(sig))
    by_cve = F.concat_ws(":", primary, cwe, F.coalesce(or_null(cve), or_null(demand), F.lit("unknown-cve")))
    anchor = F.coalesce(named_demand, F.when(or_null(component).isNotNull(), F.lower(trimmed(component))), F.lit("general"))
    return F.when(systemic, by_pattern).when(known, by_cve).otherwise(F.concat_ws(":", primary, cwe, anchor))


def without_versions(c: Column | str) -> Column:
    """Phrases like 'fixed in 2.3' go, other versions become a mark, addresses stay; blanks within a line are made one."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.regexp_replace(c, VERSION_PHRASE, ""), VERSION, "[VERSION_REDACTED]")
    return F.array_join(F.transform(F.split(F.regexp_replace(t, r"[ \t]+", " "), "\n"), trimmed), "\n")


def component_tokens(c: Column | str) -> Column:
    """The different tokens of a component, in order of appearance; null gives none."""
    plain = trimmed(F.regexp_replace(one_space(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"[^a-z0-9$_%.'\"\[\] ]+", " "))
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda x: x != ""))


def degenerate_anchor(c: Column | str) -> Column:
    """True where a component can't tell nodes apart: blank, or fewer than three words without any structural mark."""
    raw = one_space(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return (raw == "") | (~raw.rlike(r"[^\w$\s]") & (F.size(component_tokens(c)) < 3))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def without_step_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\d+[.)]\s+", "")


def step_lines(text: Column) -> Column:
    """The non-blank lines of a text, trimmed, without their numbers."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed)
    return F.transform(F.filter(lines, lambda x: x != ""), without_step_number)


def call_target(target: Column | str) -> tuple[Column, Column]:
    """(module, symbol) of a call as notes name it: arguments and back quotes dropped, then split at '::', at the last
    '->', or at the last dot. A variable receiver is no module, '$this' excepted; a bare name has none."""
    t = F.col(target) if isinstance(target, str) else target
    clean = trimmed(F.replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"\(.*?\)", ""), F.lit("`"), F.lit("")))
    scoped = F.contains(clean, F.lit("::"))
    module = F.when(scoped, F.substring_index(clean, "::", 1)).otherwise(F.lit(""))
    rest = F.when(scoped, F.regexp_replace(clean, r"(?s)^.*?::", "")).otherwise(clean)
    arrow = F.contains(rest, F.lit("->"))
    receiver = trimmed(F.rtrim(F.regexp_replace(rest, r"(?s)->(?!.*->).*$", ""), F.lit("()")))
    named = arrow & (module == "") & (~receiver.startswith("$") | (F.lower(receiver) == "$this"))
    module = trimmed(F.when(named, receiver).otherwise(module))
    rest = F.when(arrow, F.substring_index(rest, "->", -1)).otherwise(rest)
    dotted = (module == "") & F.contains(rest, F.lit(".")) & ~rest.startswith(".")
    symbol = trimmed(F.regexp_replace(F.when(dotted, F.substring_index(rest, ".", -1)).otherwise(rest), r"\(.*$", ""))
    return F.when(dotted, F.regexp_replace(rest, r"(?s)\.[^.]*$", "")).otherwise(module), symbol


def member_name(label: Column | str) -> Column:
    """A node's label as a bare name: lower case, without one leading dot and one closing pair of brackets."""
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(F.lower(trimmed(c)), r"^\.|\(\)$", "")


def line_number(location: Column | str) -> Column:
    """The number of a locator like L12, with or without the L; null for others."""
    c = F.col(location) if isinstance(location, str) else location
    return F.regexp_replace(trimmed(c), "^[lL]", "").try_cast("int")


def file_name(name: Column | str, max_bytes: int = 240) -> Column:
    """A name for one path component: separators become underscores; one longer than max_bytes keeps what fits of its
    start, the digest of the whole and its suffix."""
    c = F.col(name) if isinstance(name, str) else name
    safe = F.translate(c, "/\\\x00", "___")
    suffix = F.regexp_extract(safe, r"[^.](\.[^.]+)$", 1)
    room = F.greatest(F.lit(max_bytes) - F.octet_length(suffix) - F.lit(33), F.lit(0))
    # as many characters as fit: their bytes add up to the room at most
    chars = F.transform(F.split(F.substring(safe, 1, max_bytes), ""), lambda x: F.struct(x.alias("c"), F.octet_length(x).alias("n")))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    head = F.aggregate(chars, start, lambda a, x: F.when(a["n"] + x["n"] <= room, F.struct(F.concat(a["s"], x["c"]).alias("s"), (a["n"] + x["n"]).alias("n"))).otherwise(F.struct(a["s"].alias("s"), F.lit(2**30).alias("n"))), lambda a: a["s"])
    return F.when(F.octet_length(safe) <= max_bytes, safe).otherwise(F.concat(head, F.lit("-"), F.md5(safe), suffix))


# Names that have to do with security.
SECURITY_WORDS = [
    "verify", "auth", "authenticate", "authorize", "permission", "secret", "token", "password", "passwd", "credential", "tls", "ssl",
    "private_key", "privatekey", "api_key", "apikey", "csrf", "jwt", "session", "cookie", "role", "admin", "sudo", "root", "privilege",
    "debug", "trust", "allow", "bypass", "skip", "disable",
]
SECURITY_PARTS = ["secret", "password", "passwd", "token", "credential", "privatekey", "apikey", "csrf"]
# End of the fixed values.


def security_regex() -> str:
    words, parts = "|".join(SECURITY_WORDS), "|".join(SECURITY_PARTS)
    return rf"^(?:{words})|(?:^|[_\-./])(?:{words})(?:[_\-./]|$)|(?:{parts})"


def security_name(label: Column | str) -> Column:
    """Whether a name begins with or holds, set off, a word of security, or anywhere one of the gravest."""
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.trim(F.lower(trimmed(c)), F.lit("()")).rlike(security_regex()), F.lit(False))


def cwe_list(c: Column | str) -> Column:
    """The different entries of a list, trimmed, without null and blank ones, in order; null is the empty list."""
    a = F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(a, trimmed), lambda x: x.isNotNull() & (x != "")))


def embedding_text(kind: Column, cwe: Column, component: Column, description: Column) -> Column:
    """What is embedded of a finding: kind, class, component and text, the latter two in lower case."""
    comp, desc = trimmed(F.coalesce(component, F.lit(""))), trimmed(F.coalesce(description, F.lit("")))
    body = F.lower(F.when(comp != "", F.concat(comp, F.lit(". "), desc)).otherwise(desc))
    return trimmed(F.concat_ws(" ", or_null(F.coalesce(kind, F.lit(""))), or_null(F.coalesce(cwe, F.lit(""))), or_null(body)))


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a time like 2024-01-02T03:04:05.678901234Z, nanoseconds cut off, UTC where no zone is
    given; null for what is no time."""
    t = trimmed(c)
    cut = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.unix_micros(F.try_to_timestamp(cut))


def fits_inline(c: Column | str) -> Column:
    """At most 20 lines of at most 90 characters and no fence; null and empty texts don't."""
    t = F.col(c) if isinstance(c, str) else c
    lines = F.split(trimmed(t), "\n")
    return F.coalesce((F.length(trimmed(t)) > 0) & (F.size(lines) <= 20) & F.forall(lines, lambda x: F.length(x) <= 90) & ~F.contains(t, F.lit("```")), F.lit(False))


def slug(c: Column | str, most: int = 60) -> Column:
    """A name of letters, digits and dashes, in lower case, at most `most` characters."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(s, 1, most), F.lit("-"))


def canonical(c: Column, kind: DataType, without: str | None = None, sort_by: str | None = None) -> Column:
    """A nested value in one order: the fields of every struct by name, without those named `without` at any depth; lists of
    structs with a field `sort_by` in order of it (null as ''), then of the rest. Maps stay as they are."""
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if f.name != without), key=lambda f: f.name)
        made = F.struct(*[canonical(c.getField(f.name), f.dataType, without, sort_by).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, ArrayType):
        out = F.transform(c, lambda x: canonical(x, kind.elementType, without, sort_by))
        if sort_by and isinstance(kind.elementType, StructType) and sort_by in kind.elementType.names:
            keyed = F.transform(out, lambda x: F.struct(F.coalesce(x.getField(sort_by), F.lit("")).alias("k"), F.to_json(x, {"ignoreNullFields": "false"}).alias("j"), x.alias("x")))
            out = F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["j"] < b["j"], -1).when(a["j"] > b["j"], 1).otherwise(0)), lambda y: y["x"])
        return out
    return c


def canonical_json(df: DataFrame, column: str, without: str | None = None, sort_by: str | None = None) -> Column:
    """The text of a nested column in canonical order, null fields included: equal values have equal texts, so it breaks ties
    and, as a digest, names what is cached."""
    return F.to_json(canonical(F.col(column), df.schema[column].dataType, without, sort_by), {"ignoreNullFields": "false"})


def content_key(df: DataFrame, column: str) -> Column:
    """The digest under which a verdict on a record is cached: what its score was estimated at plays no part, nor does the
    order of its peers."""
    return F.md5(canonical_json(df, column, "cvss_vector", "vuln_id"))


def clipped(texts: Column, most: int, each: int, joined: int, between: str = "\n") -> Column:
    """The first `most` texts of a list, each cut at `each` characters, together cut at `joined`; nulls are left out."""
    parts = F.slice(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, most)
    return F.substring(F.array_join(F.transform(parts, lambda x: F.substring(x, 1, each)), between), 1, joined)


def shown_list(items: Column, most: int) -> Column:
    """The first `most` of the different entries in order, and how many more there are."""
    a = F.array_sort(F.array_distinct(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    more = F.when(F.size(a) > most, F.concat(F.lit(" (+"), F.size(a) - most, F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(a, 1, most), ", "), more)
