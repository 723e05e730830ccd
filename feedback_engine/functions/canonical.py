"""Canonical form of "Topic: description" texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions import canonical_tables as T
from feedback_engine.functions.text import stripped


Named = dict[str, Column]


@dataclass(frozen=True)
class Tables:
    """What the canonicaliser knows: whole texts, topics and descriptions with what replaces them, and descriptions that go by their topic."""

    overrides: Mapping[str, str] = field(default_factory=lambda: T.OVERRIDES)
    prefixes: Mapping[str, str] = field(default_factory=lambda: T.PREFIXES)
    suffixes: Mapping[str, str] = field(default_factory=lambda: T.SUFFIXES)

    def by_topic(self) -> list[tuple[tuple[str, ...], list[tuple[tuple[str, ...], str]], str | None]]:
        """(descriptions, [(topics, replacement)], replacement for other topics)."""
        praise = [(T.FUN, "fun"), (T.SATISFYING, "satisfying"), (T.BEAUTIFUL, "beautiful")]
        return [
            (T.PRAISE, [*praise, (T.GOOD, "good")], None),
            (("good",), praise, None),
            (T.UNEVEN, [(T.UNEVEN_TOPICS, "skill disparity")], None),
            (T.ANNOYING, [(T.COMBAT, "unfun to play against")], "annoying"),
        ]

    def topic(self, head: str) -> str:
        return self.prefixes.get(head.strip().lower()) or head[:1].upper() + head[1:]

    def description(self, head: str, tail: str) -> str:
        tail = self.suffixes.get(tail.strip().lower(), tail)
        for descriptions, choices, other in self.by_topic():
            if tail.strip().lower() in descriptions:
                return next((out for topics, out in choices if head in topics), tail if other is None else other)
        return tail

    def once(self, text: str) -> str:
        """One pass over a text: the rule that the Columns follow."""
        if text in self.overrides:
            return self.overrides[text]
        head, colon, tail = text.partition(": ")
        if not colon:
            return text
        head = self.topic(head)
        return f"{head}: {self.description(head, tail)}"

    def _texts(self) -> Iterator[str]:
        """A text for each way through the tables: further passes depend on nothing else."""
        choices = [c for _, cs, _ in self.by_topic() for c in cs]
        heads = {*self.prefixes, *self.prefixes.values(), *(t for topics, _ in choices for t in topics), "\0"}
        rules = {d for ds, _, other in self.by_topic() for d in (*ds, *([other] if other else []))} | {out for _, out in choices}
        yield from self.overrides
        yield from self.overrides.values()
        for text in (*self.overrides, *self.overrides.values()):
            head, _, tail = text.partition(": ")
            heads.add(head)
            rules.add(tail)
        for head in heads:
            for tail in {*self.suffixes, *self.suffixes.values(), *rules, "\0"}:
                yield f"{head}: {tail}"

    def passes(self) -> int:
        """How many passes bring any text to its fixed point. All texts are followed together, each pass pointing them one step on; tables that lead in a circle are refused."""
        at, n = set(self._texts()), 0
        seen = set(at)
        while at:
            after = {x: self.once(x) for x in at}
            at = {b for a, b in after.items() if a != b}
            seen |= at
            n += bool(at)
            if n > len(seen):
                raise ValueError(f"the tables lead in a circle, over {min(at)!r}")
        return n


def _looked_up(table: Mapping[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _steps(tables: Tables) -> list[Callable[[Named], Named]]:
    """One pass over `text`, as columns made from those before; the last step makes `text` anew."""

    def parted(c: Named) -> Named:
        at = F.instr(c["text"], ": ")
        return {"at": at, "head": F.substring(c["text"], F.lit(1), at - 1), "tail": F.substring(c["text"], at + 2, F.length(c["text"]))}

    def known(c: Named) -> Named:
        key = lambda x: stripped(F.lower(c[x]))
        return {"topic": _looked_up(tables.prefixes, key("head")), "description": _looked_up(tables.suffixes, key("tail")), "whole": _looked_up(tables.overrides, c["text"])}

    def replaced(c: Named) -> Named:
        raised = F.concat(F.upper(F.substring(c["head"], 1, 1)), F.substring(c["head"], F.lit(2), F.length(c["head"])))
        return {"head": F.coalesce(c["topic"], raised), "tail": F.coalesce(c["description"], c["tail"])}

    def lowered(c: Named) -> Named:
        return {"low": stripped(F.lower(c["tail"]))}

    def joined(c: Named) -> Named:
        by_topic = F
        for descriptions, choices, other in tables.by_topic():
            out = F
            for topics, replacement in choices:
                out = out.when(c["head"].isin(*topics), replacement)
            by_topic = by_topic.when(c["low"].isin(*descriptions), out.otherwise(c["tail"] if other is None else F.lit(other)))
        return {"text": F.when(c["whole"].isNotNull(), c["whole"]).when(c["at"] == 0, c["text"]).otherwise(F.concat(c["head"], F.lit(": "), by_topic.otherwise(c["tail"])))}

    return [parted, known, replaced, lowered, joined]


def canonicalised(df: DataFrame, text: str = "text", name: str = "canonical", tables: Tables | None = None, passes: int | None = 1) -> DataFrame:
    """df with the canonical form of a text; passes=None: as many as the tables need for the fixed point.

    A whole text in overrides is replaced as it is. Otherwise the topic before the
    first ": " and the description after it are looked up in lower case, and some
    descriptions then depend on the topic. Each step is a column of its own, so no
    expression is computed more than once.
    """
    tables = tables or Tables()
    out, kept = df.withColumn("_c_text", F.col(text)), df.columns
    for _ in range(tables.passes() if passes is None else passes):
        for step in _steps(tables):
            made = step({c.removeprefix("_c_"): F.col(c) for c in out.columns if c.startswith("_c_")})
            out = out.withColumns({f"_c_{n}": c for n, c in made.items()})
    return out.select(*[F.col(f"`{c}`") for c in kept if c != name], F.col("_c_text").alias(name))


def canonical(text: Column, tables: Tables | None = None, passes: int | None = 1) -> Column:
    """canonicalised() for an expression; each step is bound as the element of an array, which is slower than a column."""
    tables = tables or Tables()

    def bound(steps: list[Callable[[Named], Named]], columns: Named) -> Column:
        columns = columns | steps[0](columns)
        if len(steps) == 1:
            return columns["text"]
        one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
        return F.element_at(F.transform(one, lambda s: bound(steps[1:], {n: s[n] for n in columns})), 1)

    for _ in range(tables.passes() if passes is None else passes):
        text = bound(_steps(tables), {"text": text})
    return text
