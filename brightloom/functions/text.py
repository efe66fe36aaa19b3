"""Column functions over texts, paths and payloads: normalised forms, mentions, redaction, safe paths, bounded entries, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and names of test files.
TEST_PATH = r"(^|/)(tests?|__tests__)(/|$)|(^|/)(test_[^/]+|[^/]+_test|[^/]+\.(test|spec))\."
#: Last parts of dotted names that are files, and parts that end the name of a host.
FILE_ENDINGS = ("py", "pyi", "md", "rst", "txt", "toml", "yml", "yaml", "json", "ts", "tsx", "js", "jsx", "css", "html", "ini", "cfg")
DOMAINS = (
    "ai", "app", "biz", "cloud", "co", "com", "dev", "digital", "edu", "games", "gov", "info", "io", "live", "me", "media", "net", "online", "org", "shop", "site",
    "social", "software", "store", "studio", "tech", "technology", "website", "world", "xyz",
)
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"


def normalised(text: Column) -> Column:
    """Lower case, runs of ASCII white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def heading_key(text: Column) -> Column:
    """The runs of a-z and 0-9 of a heading in lower case, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def contains_phrase(phrases: Column, text: Column) -> Column:
    """Whether the normalised text holds one of the phrases."""
    return F.exists(phrases, lambda p: F.contains(normalised(text), normalised(p)))


def safe_filename(name: Column, longest: int = 120) -> Column:
    """The last segment of a name with anything but letters, digits, dot, dash and underscore as underscores, bounded; `upload` if nothing is left."""
    kept = F.left(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), "[^A-Za-z0-9._-]+", "_"), F.lit(longest))
    return F.when(F.length(F.regexp_replace(kept, "[._]", "")) > 0, kept).otherwise("upload")


def summary(*candidates: Column, longest: int = 200) -> Column:
    """The first candidate that is neither missing nor blank, cut."""
    return F.left(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates]), F.lit(longest))


def canonical_path(path: Column) -> Column:
    """A relative path with forward slashes, without empty and `.` segments; null if it is absolute, has a drive, a `..` or nothing."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(is_safe_path(path), F.nullif(F.array_join(parts, "/"), F.lit("")))


def is_safe_path(path: Column) -> Column:
    """Relative, without a drive, a NUL or a `..` segment."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = F.rlike(flat, F.lit("^(/|[A-Za-z]:)")) | F.exists(F.split(flat, "/"), lambda p: p == "..") | F.contains(flat, F.lit("\u0000"))
    return F.coalesce((F.length(flat) > 0) & ~bad, F.lit(False))


def is_test_path(path: Column) -> Column:
    return F.coalesce(F.rlike(path, F.lit(TEST_PATH)), F.lit(False))


def base64_text(data: Column) -> Column:
    """Base64 in one line; Spark's own has a line break after every 76 signs."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def strict_base64(text: Column) -> Column:
    """Decoded bytes of canonical base64, null for anything else."""
    fits = F.rlike(text, F.lit("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    data = F.when(fits, F.unbase64(text))
    return F.when(base64_text(data) == text, data)


def symbol_mentions(text: Column) -> Column:
    """Dotted names that a text mentions, sorted, each once: no files, no parts of e-mail addresses, and no hosts, by whose endings a name may also go on."""
    found = F.regexp_extract_all(F.regexp_replace(text, EMAIL, " "), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){DOTTED}"), F.lit(0))
    parts = lambda w: F.split(F.lower(w), r"\.")
    host = lambda p: F.exists(F.sequence(F.lit(1), F.size(p) - 1), lambda i: p[i].isin(*DOMAINS) & ~F.contains(p[i - 1], F.lit("_")))
    names = F.filter(found, lambda w: ~F.element_at(parts(w), -1).isin(*FILE_ENDINGS) & ~host(parts(w)))
    return F.array_sort(F.array_distinct(names))


def section_items(section: Column, most: int = 20, longest: int = 512) -> Column:
    """The lines of a section that are not blank, trimmed and cut, at most `most`."""
    lines = F.filter(F.transform(F.split(section, "\n"), lambda x: F.left(F.trim(x), F.lit(longest))), lambda x: x != "")
    return F.slice(lines, 1, most)


def absolute_range(base_line: Column, base_char: Column, line: Column, char: Column) -> Column:
    """A place relative to a part as a place in the whole; lines count from 1, characters from 0."""
    return F.struct((base_line + line - 1).cast("long").alias("line"), (base_char + char).cast("long").alias("char"))


def is_vector(vector: Column, dims: int) -> Column:
    """A vector of `dims` finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def canonical_json(entries: Column) -> Column:
    """A map of strings as JSON with sorted keys and no spaces."""
    quoted = lambda s: F.to_json(F.array(s))
    bare = lambda s: F.substring(quoted(s), F.lit(2), F.length(quoted(s)) - 2)
    pairs = F.transform(F.array_sort(F.map_keys(entries)), lambda k: F.concat(bare(k), F.lit(":"), F.coalesce(bare(entries[k]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def versioned_fingerprint(version: str, entries: Column, volatile: tuple[str, ...] = ()) -> Column:
    """SHA-256 of {"value": entries, "version": version} as canonical JSON; volatile keys (run ids, fingerprints) are left out first."""
    steady = F.map_filter(entries, lambda k, _: ~k.isin(*volatile)) if volatile else entries
    body = F.concat(F.lit('{"value":'), canonical_json(steady), F.lit(f',"version":"{version}"}}'))
    return F.sha2(body.cast("binary"), 256)


def bounded_entries(entries: Column, most: int = 6) -> Column:
    """Entries of a map as `key=value`, those whose key names tokens first, then by key, at most `most`."""
    order = lambda k: F.struct((~F.contains(F.lower(k), F.lit("token"))).alias("later"), k.alias("key"))
    keys = F.transform(F.array_sort(F.transform(F.map_keys(entries), order)), lambda x: x["key"])
    return F.slice(F.transform(keys, lambda k: F.concat(k, F.lit("="), entries[k])), 1, most)


def iso_utc(at: Column) -> Column:
    """A UTC timestamp as ISO 8601 with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
