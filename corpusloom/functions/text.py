"""Column expressions over text, paths and identifiers. All run in the JVM."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix to language.
LANGUAGES = {
    ".al": "al",
    ".blade.php": "blade",
    ".c": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cs": "csharp",
    ".cshtml": "razor",
    ".cxx": "cpp",
    ".dart": "dart",
    ".ex": "elixir",
    ".go": "go",
    ".h": "c",
    ".hpp": "cpp",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".php": "php",
    ".pl": "perl",
    ".py": "python",
    ".rb": "ruby",
    ".rs": "rust",
    ".sql": "sql",
    ".swift": "swift",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".vue": "vue",
    ".xml": "xml",
    ".xul": "xml",
}

_SPACE = r"[\s\p{Z}\x85]"


def trim_unicode(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def clamp_line(c: Column, most: int = 200) -> Column:
    """Right-trimmed, then at most `most` characters."""
    return F.substring(F.regexp_replace(c, f"{_SPACE}+$", ""), 1, most)


def tokenize(c: Column) -> Column:
    """Identifier to lower-case tokens of two or more letters and digits; a lower-to-upper change separates."""
    parts = F.regexp_extract_all(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"), F.lit("[a-zA-Z0-9]{2,}"), F.lit(0))
    return F.transform(parts, F.lower)


def unique_terms(values: list[str]) -> list[str]:
    """Trimmed, lower-cased, non-blank, each once, in order."""
    return list(dict.fromkeys(v.strip().lower() for v in values if v.strip()))


def tokens_of(text: str) -> list[str]:
    """tokenize() for a value known while planning."""
    return [t.lower() for t in re.findall("[a-zA-Z0-9]{2,}", re.sub("([a-z])([A-Z])", r"\1_\2", text))]


def count_literal(c: Column, needle: str) -> Column:
    """Occurrences of a literal that do not overlap, without regard to case."""
    low = needle.lower()
    return F.when(F.lit(low == ""), F.lit(0)).otherwise(((F.length(c) - F.length(F.replace(F.lower(c), F.lit(low), F.lit("")))) / max(1, len(low))).cast("int"))


def word_count(c: Column, word: str) -> Column:
    """Occurrences of a word between ASCII word boundaries, case-sensitive."""
    return F.regexp_count(c, F.lit(rf"(?<![0-9A-Za-z_])\Q{word}\E(?![0-9A-Za-z_])"))


def path_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def path_base(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def path_stem(c: Column) -> Column:
    """Base name without its last suffix, lower-cased."""
    return F.lower(F.regexp_replace(path_base(c), r"\.[^.]*$", ""))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.lower(path).endswith(".blade.php"), "blade").otherwise(F.try_element_at(table, path_extension(path)))


def normal_path(c: Column) -> Column:
    """Trimmed, with forward slashes, without `.` parts, doubled and trailing slashes; `..` takes the part before it away, is lost at the root and
    stays at the begin of a relative path. The folder itself is empty."""
    p = F.replace(trim_unicode(c), F.lit("\\"), F.lit("/"))
    rooted = F.startswith(p, F.lit("/"))

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = F.when(last.isNotNull() & (last != ".."), F.slice(kept, 1, F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part == "..", back).otherwise(F.concat(kept, F.array(part)))

    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    folded = F.when(F.array_contains(parts, ".."), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))


def chunk_path(c: Column) -> Column:
    """normal_path of a path inside a repository, whatever slashes stand around it; empty for one that leads out of it."""
    p = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\s*(?:\./)?/*", "")
    p = normal_path(p)
    return F.when((p == "..") | F.startswith(p, F.lit("../")), "").otherwise(p)


def clean_path(path: str) -> str:
    """What normal_path gives, of one argument."""
    p = path.strip().replace("\\", "/")
    if not p:
        return ""
    p = posixpath.normpath(("/" if p.startswith("/") else "") + p.lstrip("/"))
    return "" if p == "." else p


def glob_to_regex(pattern: str) -> str | None:
    """A path glob as an anchored regular expression: * and ? stay within a path part, classes are kept. None if malformed."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", k + 2)
            body = pattern[k + 1 : end]
            if end < 0 or body in ("", "^"):
                return None
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            k = end
        elif c == "\\":
            if k + 1 == len(pattern):
                return None
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def matches_path(path: Column, pattern: str) -> Column:
    """The glob or the glob below one directory; blank matches all, malformed nothing."""
    if not pattern.strip():
        return F.lit(True)
    own, below = glob_to_regex(pattern), glob_to_regex(f"*/{pattern}")
    return F.lit(False) if own is None else path.rlike(own) | path.rlike(below)


def user_regex(pattern: str) -> str:
    """A checked pattern for case-insensitive search. Too long, nested quantifiers, and what a linear-time engine refuses are errors."""
    if len(pattern.encode()) > 200:
        raise ValueError("the pattern is longer than 200 bytes")
    if re.search(r"[+*]\s*\)\s*[+*{]", pattern):
        raise ValueError("nested quantifiers are not allowed")
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("lookaround and back references are not allowed")
    re.compile(pattern)
    return "(?iud)" + pattern


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normal_list(c: Column) -> Column:
    """Trimmed, non-blank, distinct, sorted strings."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, trim_unicode), lambda x: x != "")))
