"""Text functions on native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that n-grams leave out.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "just", "don", "now", "and", "but", "or", "if", "while", "that", "this", "it", "its", "i",
    "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "they", "them", "their", "what", "which", "who", "whom", "up", "about",
    "s", "t", "re", "ve", "d", "ll", "m", "really", "much", "get", "got", "like", "also", "even",
)
#: Java flags that make a rule ignore case and see Unicode words and lines that end in \n alone.
FLAGS = "(?idU)"


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def letter_share(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")).cast("double"), F.length(text).cast("double"))


def readable(text: Column, least: int = 20, share: float = 0.35) -> Column:
    """Long enough, and letters enough to be prose."""
    return F.coalesce((F.length(text) >= least) & (letter_share(text) > share), F.lit(False))


def topic(text: Column) -> Column:
    """What stands before the first ": "; empty without one."""
    at = F.instr(text, ": ")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("")


def words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The words that are left after links, other characters, stop words and single letters are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), r"[^a-z\s]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def ngrams(text: Column, n: int, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """n-grams of the words of a text, in order. The words are bound once, so time grows with the text's length and not with its square."""

    def runs(ws: Column) -> Column:
        places = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(ws, i, n), " "))

    return F.flatten(F.transform(F.array(words(text, stop_words)), runs))


def plain(text: Column) -> Column:
    """The text for patterns in ASCII, in small letters: other letters, digits and marks become "_", which is part of a word as they are, other signs blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F\p{L}\p{N}\p{M}]", " "), r"[^\x00-\x7F]", "_"))


def _divided(pattern: str) -> bool:
    """Whether a pattern has a "|" outside of all groups."""
    depth = inside = at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = 1
        elif c == "|" and not depth:
            return True
        depth += (c == "(") - (c == ")") if not inside else 0
        at += 1
    return False


def alternation(patterns: Sequence[str]) -> str:
    """One pattern for all; a word boundary that many begin with is tried once at each place."""
    edge = [p[2:] for p in patterns if p.startswith(r"\b") and not _divided(p)]
    rest = [p for p in patterns if not p.startswith(r"\b") or _divided(p)]
    parts = [r"\b(?:" + "|".join(edge) + ")"] if edge else []
    return "|".join([*parts, *(f"(?:{p})" for p in rest)])


def _literals(parsed: parser.SubPattern) -> tuple[str, ...] | None:
    """Strings of which every match holds one; the choice whose shortest is longest."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, value in [*parsed, (ops.ANY, None)]:
        if op is ops.LITERAL:
            run += chr(value).lower()
            continue
        if op is ops.AT:  # takes no character
            continue
        if run:
            found.append((run,))
        run, inner = "", None
        if op is ops.SUBPATTERN:
            inner = _literals(value[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0]:
            inner = _literals(value[2])
        elif op is ops.BRANCH:
            parts = [_literals(x) for x in value[1]]
            inner = tuple(dict.fromkeys(x for p in parts for x in p)) if all(parts) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def needed(pattern: str) -> tuple[str, ...] | None:
    """Small-letter strings of which a text must hold one for the pattern to match; None if no such list is known."""
    try:
        return _literals(parser.parse(pattern))
    except (re.error, OverflowError):  # Java's own syntax
        return None


def example(pattern: str) -> str:
    """A text that a pattern matches: first choices, fewest repeats but one at least, a letter for a class."""

    def shown(parsed: parser.SubPattern) -> str:
        out = ""
        for op, value in parsed:
            if op is ops.LITERAL:
                out += chr(value)
            elif op is ops.SUBPATTERN:
                out += shown(value[3])
            elif op is ops.BRANCH:
                out += shown(value[1][0])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                out += shown(value[2]) * max(value[0], 1)
            elif op is ops.IN:
                kind, first = value[0]
                out += {ops.CATEGORY_DIGIT: "7", ops.CATEGORY_SPACE: " "}.get(first, "a") if kind is ops.CATEGORY else chr(first if kind is ops.LITERAL else first[0])
            elif op is ops.ANY:
                out += " "
        return out

    return shown(parser.parse(pattern))


#: Stands among a text's findings for letters beyond Latin-1; no plain text holds it.
FAR = "\uffff"


class Dictionary:
    """The strings that the patterns of many rules need, found in a text by one pass over it.

    A text is read once by a lookahead whose pattern is the trie of all strings, so
    at each place the longest that begins there is found, and with it every string
    that begins it. A rule's own pattern then runs only where one of its strings
    was found.
    """

    def __init__(self, patterns: Iterable[str]) -> None:
        patterns = list(patterns)
        self.strings = sorted({w for p in patterns for w in needed(p) or () if w.isascii()})
        self.letters = sorted({x for p in patterns for c in p if c > "\u00ff" for x in (c.lower(), c.upper())})

    def found(self, bare: Column) -> Column:
        """The distinct strings that a plain text holds, but those that only begin a longer one where it stands."""
        if not self.strings:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(bare, F.lit(f"(?=({trie(self.strings)}))"), F.lit(1)))

    def far(self, text: Column, found: Column) -> Column:
        """found with FAR added where the text has a letter beyond Latin-1 that some pattern has."""
        if not self.letters:
            return found
        return F.when(text.rlike(f"[{self.letters[0]}-{self.letters[-1]}]"), F.array_append(found, F.lit(FAR))).otherwise(found)

    def held(self, found: Column, strings: Iterable[str]) -> Column:
        """Whether a text with these findings holds one of the strings."""
        own = sorted({x for w in strings for x in self.strings if x.startswith(w)})
        return reduce(lambda a, b: a | b, [F.array_contains(found, x) for x in own])


def trie(strings: Iterable[str]) -> str:
    """One pattern for the longest of the strings that begins at a place; no two branches begin alike."""
    root: dict = {}
    for s in strings:
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        parts = [re.sub(r"([^\w\s])", r"\\\1", c) + shown(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        if "" in node:
            return "(?:" + "|".join(parts) + ")?"
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return shown(root)


def any_match(text: Column, patterns: Sequence[str], bare: Column | None = None, known: tuple[Dictionary, Column] | None = None) -> Column:
    """Whether one of the patterns is found, whatever the case, by Unicode words.

    Patterns in ASCII run on the plain text (bare, if it is at hand), where Java
    needs no Unicode tables, and only if it holds a string that they need; others
    on the text itself, and only where it has a letter of theirs that a match
    needs, or a string if a match can do without such letters. known: a
    dictionary of these patterns' strings and what it found in the text; without
    it the text is searched for each string.
    """
    narrow, wide = [p for p in patterns if p.isascii()], [p for p in patterns if not p.isascii()]
    low, tests = plain(text) if bare is None else bare, []
    by_need: dict[tuple[str, ...] | None, list[str]] = {}
    for p in narrow:
        by_need.setdefault(needed(p), []).append(p)
    for words, ps in by_need.items():
        found = low.rlike("(?id)" + alternation(ps))
        if words:
            found = (known[0].held(known[1], words) if known else reduce(lambda a, b: a | b, [low.contains(w) for w in words])) & found
        tests.append(found)
    held = lambda words: known[0].held(known[1], words) if known else reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    lettered = []
    for p in wide:
        words = needed(p) or ("",)
        if not any(w.isascii() for w in words):
            lettered.append(p)
        elif all(words):  # a choice without other letters
            found = held([w for w in words if w.isascii()])
            other = "".join(sorted({c for w in words for x in w if not x.isascii() for c in (x.lower(), x.upper())}))
            tests.append((found | text.rlike(f"[{other}]") if other else found) & text.rlike(FLAGS + p))
        else:
            tests.append(text.rlike(FLAGS + p))
    if lettered:
        letters = sorted({c for p in lettered for x in p if not x.isascii() for c in (x.lower(), x.upper())})
        far = [c for c in letters if c > "\u00ff"]  # a range is one comparison
        some = "[" + "".join(c for c in letters if c <= "\u00ff") + (f"{far[0]}-{far[-1]}" if far else "") + "]"
        test = text.rlike(some) & text.rlike(FLAGS + alternation(lettered))
        tests.append(F.array_contains(known[1], FAR) & test if known and len(far) == len(letters) else test)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def tags(text: Column, rules: Sequence[tuple[str, Sequence[str]]], bare: Column | None = None, known: tuple[Dictionary, Column] | None = None) -> Column:
    """Names of the rules (name, patterns) that match, in their order."""
    return F.filter(F.array(*[F.when(any_match(text, p, bare, known), F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())


def tags_by_side(text: Column, negative: Column, negatives: Sequence[tuple[str, Sequence[str]]], positives: Sequence[tuple[str, Sequence[str]]], bare: Column | None = None, known: tuple[Dictionary, Column] | None = None) -> Column:
    """The tags of one of two tables of rules, by the side of the text; the other table's rules do not run."""
    return F.when(negative, tags(text, negatives, bare, known)).otherwise(tags(text, positives, bare, known))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out if it is read in fewer tasks than there are cores, before costly expressions; a large table is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prepared(df: DataFrame, patterns: Iterable[str], text: str = "text", deal: bool = True) -> tuple[DataFrame, Column, tuple[Dictionary, Column]]:
    """df with what matching many patterns shares, made once a text: the plain text (_bare) and the strings it holds (_held). And both as any_match() takes them.

    The table goes through spread() unless told otherwise.
    """
    book = Dictionary(patterns)
    df = (spread(df) if deal else df).withColumn("_bare", plain(F.col(text)))
    return df.withColumn("_held", book.far(F.col(text), book.found(F.col("_bare")))), F.col("_bare"), (book, F.col("_held"))
