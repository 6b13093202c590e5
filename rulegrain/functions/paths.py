"""Native path expressions and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """Directory of a file; `.` at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def proper_ancestors(path: Column) -> Column:
    """Directories above a file, outermost first, without the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def chain(directory: Column) -> Column:
    """A directory and all above it, innermost first, the root as `.`."""
    p = parts(directory)
    up = F.reverse(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/")))
    return F.when(directory == ".", F.array(F.lit("."))).otherwise(F.concat(up, F.array(F.lit("."))))


def join(directory: Column, relative: Column) -> Column:
    return F.when(directory == ".", relative).otherwise(F.concat(directory, F.lit("/"), relative))


def resolve(path: Column) -> Column:
    """Path without `.` and `..`; null if it leaves the root, empty if it is the root."""
    step = lambda acc, s: F.when(acc.isNull() | s.isin("", "."), acc).when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    return F.array_join(F.aggregate(parts(path), F.array().cast("array<string>"), step), "/")


def matching_end(glob: str, opened: int) -> int | None:
    """Where the brace that opens at a place is closed."""
    level = 0
    for at, c in enumerate(glob[opened:], opened):
        level += (c == "{") - (c == "}")
        if level == 0:
            return at
    return None


def split_outside_braces(body: str, trim: bool = False) -> list[str]:
    """Parts between commas that no brace holds."""
    found, level = [""], 0
    for c in body:
        level = max(0, level + (c == "{") - (c == "}"))
        if c == "," and not level:
            found.append("")
        else:
            found[-1] += c
    return [p for x in found if (p := x.strip())] if trim else found


def glob_pattern(glob: str) -> str:
    """Source of the regular expression that a glob stands for, to be matched whole."""
    if (m := re.match(r"\*\*/|\*\*|\*|\?", glob)) is not None:
        return {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]] + glob_pattern(glob[m.end() :])
    if not glob:
        return ""
    if glob[0] == "{" and (end := matching_end(glob, 0)) is not None:
        return f"(?:{'|'.join(map(glob_pattern, split_outside_braces(glob[1:end])))})" + glob_pattern(glob[end + 1 :])
    plain = re.match(r"[^*?{]+|\{", glob)[0]
    return re.escape(plain) + glob_pattern(glob[len(plain) :])


#: Stand for what has been read of a glob; no text has these code points.
BEGIN, END, OR, FOLDERS, ALL = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"


def glob_regex(glob: Column) -> Column:
    """The regular expression of a glob column, to be looked for in a path: it begins and ends with it."""
    n = F.length(glob) - F.length(F.translate(glob, "{", ""))
    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # braces are paired from the innermost on; those without a partner are characters
    paired = F.aggregate(rounds, glob, lambda acc, _: F.regexp_replace(acc, r"\{([^{}]*)\}", f"{BEGIN}$1{END}"))
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when((c == ",") & (acc["level"] > 0), OR).otherwise(c)).alias("out"), (acc["level"] + F.when(c == BEGIN, 1).when(c == END, -1).otherwise(0)).alias("level")
    )
    split = F.aggregate(F.split(paired, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("level")), step)["out"]
    plain = F.regexp_replace(F.when(n > 0, split).otherwise(glob), r"([.+^$()|\[\]\\{}])", r"\\$1")
    stars = F.replace(F.replace(plain, F.lit("**"), F.lit(ALL)), F.lit(ALL + "/"), F.lit(FOLDERS))
    names = F.replace(F.replace(stars, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    for mark, means in ((FOLDERS, "(?:[^/]+/)*"), (ALL, ".*"), (BEGIN, "(?:"), (END, ")"), (OR, "|")):
        names = F.replace(names, F.lit(mark), F.lit(means))
    return F.concat(F.lit(r"(?s)\A(?:"), names, F.lit(r")\z"))


def glob_matches(glob: str, path: str) -> bool:
    """Whether a glob matches a path; one without a slash is matched with the base name."""
    return re.fullmatch(glob_pattern(glob), path if "/" in glob else path.rpartition("/")[2], re.DOTALL) is not None


def like_globs(path: Column, globs: list[str]) -> Column:
    """Whether any glob of a bounded list matches the whole path."""
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(f"^(?:{glob_pattern(g)})$")
    return found
