"""Native text expressions: words, shingles, sentences, polarity, classification, quoting, identity.

Every function takes and returns Columns, so plans stay inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
WORD_INSIDE = r"[\p{L}\p{N}/*.@-]"
WORD_ENDS = r"[\p{L}\p{N}/*@]"
NEGATIVE_WORDS = r"never|don'?t|do not|avoid|must not|no"
POSITIVE_WORDS = r"always|must|prefer|use|do"
CONDITIONAL_WORDS = r"when|if|where"
CRITICAL_WORDS = r"never|must(?: not)?|always|do not|don'?t"
EMPHASIZED_WORDS = r"NEVER|MUST(?: NOT)?|ALWAYS|DO NOT"
MODAL_WORDS = r"must(?: not)?|never|always|do not|don'?t|should(?: not)?|required|banned|only|forbidden"
IMPERATIVE_STARTS = (
    "use|do|don'?t|never|always|avoid|prefer|keep|run|add|remove|write|return|ensure|make|check|include|wrap|log|validate|treat|open|request|follow|"
    "coordinate|batch|watch|paginate|anonymize|store|extract|delete|fix|update|link|declare|co-locate|put|leave|send|split|name|mark|call|read|be"
)
STOPWORDS = (
    "a an the in on of for to and or so that this these those it its is are be with as at by from into your our we you they them anywhere everywhere here there"
).split()
POLARITY_WORDS = "always never must not don't dont do avoid no prefer".split()
CORE_WORDS = 9
SHINGLE = 5

#: ASCII word boundaries: Java's own see letters beyond ASCII, the reference semantics doesn't.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def bounded(words: str) -> str:
    return f"(?i){BEFORE}(?:{words}){AFTER}"


def normalize_words(text: Column) -> Column:
    """Lower-case words; letters, digits and /*.@- make words, dots and hyphens at their ends go.

    One pass of one pattern: a word begins and ends with what may end it.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD_ENDS}(?:{WORD_INSIDE}*{WORD_ENDS})?"), F.lit(0))


def word_hashes(words: Column) -> Column:
    """64-bit hashes of words, in their order."""
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of distinct runs of n words, made of their hashes; up to n words are one run, none none. hashes must be a materialised column."""
    runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, n))))
    return F.array_distinct(F.slice(runs, 1, F.greatest(F.size(hashes) - n + 1, F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def sentences(text: Column) -> Column:
    """Parts of a text after each . ! or ? with white space, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def polarity(sentence: Column) -> Column:
    return F.when(sentence.rlike(bounded(NEGATIVE_WORDS)), "negative").when(sentence.rlike(bounded(POSITIVE_WORDS)), "positive").otherwise("none")


def _first(sentence: Column, pattern: str) -> Column:
    """Where a pattern first matches, from 1; 0 if it doesn't."""
    return F.regexp_instr(sentence, F.lit(pattern))


def is_scoped_exception(sentence: Column) -> Column:
    """Starts as an exception, or a condition comes before the first polarity word."""
    condition, marker = _first(sentence, bounded(CONDITIONAL_WORDS)), _first(sentence, bounded(f"{NEGATIVE_WORDS}|{POSITIVE_WORDS}"))
    return sentence.rlike(rf"(?i)^\s*exceptions?{AFTER}") | ((condition > 0) & (marker > 0) & (condition < marker))


def directive_core(sentence: Column) -> Column:
    """Distinct pairs of neighbouring content words among the first words from the polarity word on."""
    marker = _first(sentence, bounded(f"{NEGATIVE_WORDS}|{POSITIVE_WORDS}"))
    words = F.slice(normalize_words(F.substring(sentence, marker, F.lit(1 << 30))), 1, CORE_WORDS)
    content = F.filter(words, lambda w: ~w.isin(STOPWORDS + POLARITY_WORDS))
    pairs = F.zip_with(content, F.slice(content, 2, CORE_WORDS), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.when(marker > 0, F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))).otherwise(F.array().cast("array<string>"))


def classify_rule(text: Column, n_refs: Column) -> Column:
    imperative = text.rlike(bounded(MODAL_WORDS)) | text.rlike(rf"(?i)^(?:{IMPERATIVE_STARTS}){AFTER}")
    return F.when(imperative, "imperative").when(n_refs > 0, "structure-claim").when(F.length(text) > 30, "context").otherwise("unknown")


def is_critical(text: Column) -> Column:
    return text.rlike(bounded(CRITICAL_WORDS))


def is_emphasized(text: Column) -> Column:
    return text.rlike(f"{BEFORE}(?:{EMPHASIZED_WORDS}){AFTER}")


def quote(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def percent(ratio: Column) -> Column:
    """Rounded half up, as text."""
    return F.floor(ratio * 100 + 0.5).cast("string")


def fingerprint(category: Column, rule_ids: Column, paths: Column, message: Column) -> Column:
    """Identity of a finding that survives moved lines and changed counts."""
    shape = F.regexp_replace(message, "[0-9]+", "#")
    return short_hash(F.concat_ws("|", category, F.array_join(F.array_sort(rule_ids), ","), F.array_join(F.array_sort(paths), ","), shape))


def estimate_tokens(text: Column) -> Column:
    """Tokens as a quarter of the characters, rounded up: an estimate, as vocabularies aren't part of the package."""
    return F.ceil(F.length(text) / 4).cast("int")
