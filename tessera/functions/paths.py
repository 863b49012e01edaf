"""Scalar expressions over paths, names, literals and messages. All are plain Spark columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"
DEV_DIRS = ("tests", "benches", "examples")  # fixed values: cargo's development target folders


def join_paths(path: Column, sep: str = "::") -> Column:
    return F.array_join(path, sep)


def canonical_prefixes(path: Column) -> Column:
    """All prefixes of two segments or more, shortest first; none for shorter paths."""
    long = F.transform(F.sequence(F.lit(2), F.size(path)), lambda n: F.slice(path, 1, n))
    return F.when(F.size(path) >= 2, long).otherwise(F.array().cast("array<array<string>>"))


def glob_form(pattern: Column) -> Column:
    return F.replace(F.replace(pattern, F.lit("-"), F.lit("_")), F.lit("::"), F.lit("/"))


def segments_glob_form(path: Column) -> Column:
    return F.array_join(path, "/")


def glob_regex(pattern: str) -> str:
    """A glob over `/`-separated paths as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, patterns))) if patterns else F.lit(False)


def separator_stripped(name: Column) -> Column:
    return F.translate(name, "-_", "")


def code_name(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def camel_words(name: Column) -> Column:
    """Words of a camel-case name: one starts at a capital after a small letter or digit, or at the last of a run of capitals before a small letter."""
    return F.split(name, "(?<=[\\p{Ll}0-9])(?=\\p{Lu})|(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})")


def variant_naming_hit(owner: Column, variants: Column) -> Column:
    """Three variants or more of which one repeats its owner's name at a word's edge, or that all begin or all end with one word."""
    words = F.transform(variants, camel_words)
    ends = [F.transform(words, lambda w: F.element_at(w, 1)), F.transform(words, lambda w: F.element_at(w, -1))]
    same = [F.size(F.array_distinct(x)) == 1 for x in ends]
    several = F.forall(words, lambda w: F.size(w) > 1)
    head = lambda v: v.startswith(owner) & F.substr(v, F.length(owner) + 1).rlike("^[^\\p{Ll}]")
    own = F.exists(variants, lambda v: head(v) | ((v != owner) & v.endswith(owner)))
    return (F.size(variants) >= 3) & (own | (several & (same[0] | same[1])))


def convention_violation(name: Column, self_kind: Column, copy: Column, trait_item: Column) -> Column:
    """A method whose receiver contradicts its name. Names and receivers; a reference may be a value where the type is Copy."""
    none, value = self_kind == "none", self_kind == "value"
    ref, ref_mut = (self_kind == "ref") | (copy & value), (self_kind == "ref_mut") | (copy & value)
    want = (
        F.when(name == "new", none).when(name == "to_mut", ref_mut).when(name.startswith("to_") & F.substr(name, F.lit(4)).endswith("_mut"), ref_mut)
        .when(name.startswith("to_"), F.when(copy & ~trait_item, value).otherwise(ref)).when(name.startswith("as_"), ref | ref_mut).when(name.startswith("from_"), none)
        .when(name.startswith("into_"), value).when(name.startswith("is_"), ref | none).otherwise(F.lit(True))
    )
    return ~want


def word_match(text: Column, word: Column) -> Column:
    """word as a whole word in text."""
    return F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9_])\\Q"), word, F.lit("\\E(?![A-Za-z0-9_])")))


def display_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def same_file(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def covers(path: Column, prefix: Column) -> Column:
    """prefix is path or an ancestor of it, segment by segment."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("::")))


def last_segment(path: Column, n: int = 1) -> Column:
    return F.array_join(F.slice(F.split(path, "::"), -n, n), "::") if n == 1 else F.substring_index(path, "::", -n)


def traits_match(a: Column, b: Column) -> Column:
    return (a == b) | (F.substring_index(a, "::", -1) == F.substring_index(b, "::", -1))


def in_dev_target_dir(relative: Column) -> Column:
    return F.element_at(F.split(relative, "/"), 1).isin(*DEV_DIRS)


def extract_version(output: Column, pattern: str) -> Column:
    found = F.regexp_extract(F.regexp_replace(output, ANSI, ""), pattern, 1)
    return F.when(found != "", found)


def is_sentinel(literal: Column) -> Column:
    """An empty string, or a number of value 0 or 1 before its suffix, underscores aside; radix literals are none."""
    digits = F.regexp_extract(F.replace(literal, F.lit("_"), F.lit("")), "^([0-9.]+)(?:[iuf](?:8|16|32|64|128|size))?$", 1)
    return F.coalesce((literal == '""') | digits.try_cast("double").isin(0.0, 1.0), F.lit(False))


def literal_placeholder(literal: Column) -> Column:
    """Five kinds of literal."""
    return (
        F.when(literal.rlike("^[bc]?r?#*\""), "$str").when(literal.rlike("^b?'"), "$char").when(literal.rlike("^[0-9][0-9_]*(?:\\.[0-9]|[eE]|f(?:32|64))"), "$float")
        .when(literal.rlike("^[0-9]"), "$int").otherwise("$lit")
    )


def diff_count(a: Column, b: Column) -> Column:
    """Places at which two tuples differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def escape_data(s: Column) -> Column:
    for x, y in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        s = F.replace(s, F.lit(x), F.lit(y))
    return s


def escape_property(s: Column) -> Column:
    for x, y in ((":", "%3A"), (",", "%2C")):
        s = F.replace(s if x == "," else escape_data(s), F.lit(x), F.lit(y))
    return s


def feature_names(cfg: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(cfg, F.lit('feature\\s*=\\s*"([^"]+)"'), F.lit(1)))


def feature_dependency(entry: Column) -> Column:
    """The dependency a feature entry names: dep:x, x/y, x?/y; null for bare features."""
    return F.when(entry.startswith("dep:"), F.substr(entry, F.lit(5))).when(entry.contains("/"), F.regexp_extract(entry, "^([^?/]+)\\??/", 1))


def type_base(type_text: Column) -> Column:
    """Last path segment of a type without references, lifetimes and generics."""
    bare = F.regexp_replace(type_text, "^(?:&\\s*(?:'\\w+\\s*)?(?:mut\\s+)?)+", "")
    return F.substring_index(F.regexp_replace(bare, "<.*$", ""), "::", -1)


def capped_list(items: Column, most: int = 5) -> Column:
    """The first `most` items, comma-joined, with the number of the rest as a last item."""
    rest = F.size(items) - most
    head = F.slice(items, 1, most)
    return F.array_join(F.when(rest > 0, F.array_append(head, F.format_string("and %d more", rest))).otherwise(head), ", ")


def other_sites(instances: Column, most: int = 5) -> Column:
    """`file:line` of all instances (file, line, ...) but the first, capped."""
    rest = F.slice(instances, 2, F.greatest(F.size(instances) - 1, F.lit(0)))
    return capped_list(F.transform(rest, lambda x: F.concat(display_path(x["file"]), F.lit(":"), x["line"].cast("string"))), most)


def silence_hint(file: Column, scope: Column, marker: Column, lint: Column) -> Column:
    """The directive that silences a finding: a macro where the marker crate is there, else a comment in the file's language."""
    rust = scope.isin("line", "file") & file.endswith(".rs")
    ident = F.replace(lint, F.lit("-"), F.lit("_"))
    return F.when(rust & marker, F.format_string("tessera_lint::expect!(%s);", ident)).when(rust, F.format_string("// tessera-lint: expect(%s)", lint)).otherwise(F.format_string("# tessera-lint: expect(%s)", lint))


def cache_key(files: Column) -> Column:
    """Digest of an array of (path, body)."""
    return F.sha2(F.array_join(F.transform(files, lambda f: F.concat_ws("\x00", f["path"], f["body"])), "\x01"), 256)


@F.pandas_udf(LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a/64 of the UTF-8 bytes, as a signed bit pattern; wrapping multiplication has no ANSI form."""

    def one(s):
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return texts.map(one)


# Three-valued logic of configuration predicates is SQL's own: unknown is null.
def cfg_predicate(tree, known: dict[str, Column]) -> Column:
    """("any" | "all" | "not", children) or an atom's name; unknown atoms stay null."""
    if isinstance(tree, str):
        return known.get(tree, F.lit(None).cast("boolean"))
    op, children = tree[0], [cfg_predicate(x, known) for x in tree[1:]]
    if op == "not":
        return ~children[0]
    out = F.lit(op == "all")
    for c in children:
        out = out & c if op == "all" else out | c
    return out
