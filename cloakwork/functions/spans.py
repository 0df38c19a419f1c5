"""Span detection and replacement as column expressions.

A text is walked by one pattern, the alternation of all rules in force
(`rules.joined_pattern`).  Everything else is read off the list of matches: types
and scores from each short match, offsets and the redacted text from the pieces
`split` leaves between the matches.  Work per text is linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.text import let
from cloakwork.rules import Rule, joined_pattern

ENTITY_TYPE = "struct<type:string,score:double,begin:int,end:int>"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def no_entities() -> Column:
    return F.array().cast(f"array<{ENTITY_TYPE}>")


def _with_pattern(text: Column, rules: Sequence[Rule], use: Callable[[str], Column]) -> Column:
    """Apply `use` to the joined pattern that fits the text.

    Rules with a `needs` literal are left out of the pattern for texts without
    it: looking for an `@` costs a fraction of trying an e-mail address at every
    word.
    """
    without = [r for r in rules if not r.needs]
    if len(without) == len(rules):
        return use(joined_pattern(rules))
    needed = [F.contains(text, F.lit(n)) for n in dict.fromkeys(r.needs for r in rules if r.needs)]
    either = needed[0]
    for more in needed[1:]:
        either = either | more
    found = F.when(either, use(joined_pattern(rules)))
    return found.otherwise(use(joined_pattern(without))) if without else found


SUM_BLOCK = 64


def running_sum(numbers: Column) -> Column:
    """The sum of the first n numbers, for every n.

    A fold that appends to an array copies the array at every step.  Here blocks
    are summed first and each number then added to the few before it in its block.
    """

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def in_blocks(blocks: Column) -> Column:
        def sums(totals: Column) -> Column:
            def one(block: Column, j: Column) -> Column:
                def after(before: Column) -> Column:
                    return F.transform(block, lambda x, i: before + total(F.slice(block, 1, i + 1)))

                return let(total(F.slice(totals, 1, j)), after)

            return F.flatten(F.transform(blocks, one))

        return let(F.transform(blocks, total), sums)

    def split_up(numbers: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / SUM_BLOCK).cast("int"))
        blocks = F.transform(starts, lambda j: F.slice(numbers, j * SUM_BLOCK + 1, SUM_BLOCK))
        return F.when(F.size(numbers) > 0, let(blocks, in_blocks)).otherwise(F.array().cast("array<int>"))

    return let(numbers, split_up)


def contains_match(text: Column, rules: Sequence[Rule]) -> Column:
    """True when any rule matches anywhere."""
    if not rules:
        return F.lit(False)
    return F.coalesce(_with_pattern(text, rules, lambda p: F.rlike(text, F.lit(p))), F.lit(False))


def find_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Matched texts from left to right, cues included; empty for null."""
    if not rules:
        return no_strings()
    found = _with_pattern(text, rules, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.coalesce(found, no_strings())


# Stands for a match while the pieces around it are cut out; reserved for internal
# use by Unicode, and texts that hold it all the same are cut with the pattern.
MARK = "\ufdd0"


def _pieces(text: Column, rules: Sequence[Rule]) -> Column:
    """The text between the matches: one piece more than there are matches.

    `split` compiles its pattern for every row, `regexp_replace` once.
    """

    def cut(pattern: str) -> Column:
        marked = F.regexp_replace(text, F.lit(pattern), F.lit(MARK))
        return F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(F.split(marked, MARK, -1))

    return _with_pattern(text, rules, cut)


def _by_rule(match: Column, rules: Sequence[Rule], value: Callable[[Rule], Column]) -> Column:
    """`value` of the rule that gave `match`, found by matching it once more."""
    *firsts, last = rules
    chosen = None
    for rule in firsts:
        test = F.rlike(match, F.lit(rf"\A{rule.expression}\z"))
        chosen = F.when(test, value(rule)) if chosen is None else chosen.when(test, value(rule))
    return value(last) if chosen is None else chosen.otherwise(value(last))


def _rule_score(match: Column, rule: Rule) -> Column:
    if rule.check is None:
        return F.lit(rule.score)
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.when(F.call_function("luhn_check", digits), rule.score).otherwise(rule.fail_score)


def _score(match: Column, rules: Sequence[Rule]) -> Column:
    return _by_rule(match, rules, lambda r: _rule_score(match, r))


def _type(match: Column, rules: Sequence[Rule]) -> Column:
    return _by_rule(match, rules, lambda r: F.lit(r.type))


def _rule_cue(match: Column, rule: Rule) -> Column:
    """The part of a match that announces the span."""
    return F.regexp_extract(match, rf"\A{rule.cue}", 0)


def _accepted(match: Column, rules: Sequence[Rule], threshold: float) -> Column | None:
    """Whether a match scores enough; None when every match must."""
    if all(r.min_score >= threshold for r in rules):
        return None
    return _score(match, rules) >= threshold


def match_types(matches: Column, rules: Sequence[Rule], threshold: float = 0.0) -> Column:
    """The type of every accepted match, in order, repeats included."""
    if not rules:
        return no_strings()
    if any(r.min_score < threshold for r in rules):
        matches = F.filter(matches, lambda m: _accepted(m, rules, threshold))
    return F.transform(matches, lambda m: _type(m, rules))


def redact_matches(text: Column, matches: Column, rules: Sequence[Rule], threshold: float = 0.0) -> Column:
    """The text with every accepted match written as ``[TYPE]``; cues stay."""
    if not rules:
        return text

    def token(match: Column) -> Column:
        def written(rule: Rule) -> Column:
            tag = F.lit(f"[{rule.type}]")
            tag = F.concat(_rule_cue(match, rule), tag) if rule.cue else tag
            if rule.min_score >= threshold:
                return tag
            return F.when(_rule_score(match, rule) >= threshold, tag).otherwise(match)

        # One walk through the rules, whose tests are most of the work on a match.
        return _by_rule(match, rules, written)

    # The last piece has no match behind it; `zip_with` fills in a null there.
    joined = F.array_join(
        F.zip_with(
            _pieces(text, rules),
            matches,
            lambda piece, match: F.when(match.isNull(), piece).otherwise(F.concat(piece, token(match))),
        ),
        "",
    )
    return F.when(F.size(matches) > 0, joined).otherwise(text)


def find_entities(text: Column, rules: Sequence[Rule]) -> Column:
    """Every match as ``struct<type,score,begin,end>``, offsets in code points.

    Nothing is filtered out: this is the detector's answer before a policy's
    threshold looks at it.
    """
    if not rules:
        return no_entities()

    def entity(match: Column, end: Column) -> Column:
        def as_found(rule: Rule) -> Column:
            begin = end - F.length(match)
            return F.struct(
                F.lit(rule.type).alias("type"),
                _rule_score(match, rule).alias("score"),
                (begin + F.length(_rule_cue(match, rule)) if rule.cue else begin).alias("begin"),
                end.alias("end"),
            ).cast(ENTITY_TYPE)

        # One walk through the rules, whose tests are most of the work on a match.
        return _by_rule(match, rules, as_found)

    def located(matches: Column) -> Column:
        # The last piece has no match behind it.
        pieces = F.slice(_pieces(text, rules), 1, F.size(matches))
        lengths = F.zip_with(pieces, matches, lambda piece, match: F.length(piece) + F.length(match))
        found = let(running_sum(lengths), lambda ends: F.zip_with(matches, ends, entity))
        return F.when(F.size(matches) > 0, found).otherwise(no_entities())

    return let(find_matches(text, rules), located)


def filter_entities(entities: Column, types: Sequence[str], threshold: float) -> Column:
    """Entities of the given types that score at least `threshold`."""
    wanted = [F.lit(t) for t in types]
    if not wanted:
        return F.filter(entities, lambda e: F.lit(False))
    return F.filter(entities, lambda e: e["type"].isin(*wanted) & (e["score"] >= threshold))


def filter_labels(labels: Column, types: Sequence[str], threshold: float) -> Column:
    """Whether any document-level label ``struct<name,score>`` qualifies."""
    return F.coalesce(
        F.exists(labels, lambda x: x["name"].isin(*types) & (x["score"] >= threshold)), F.lit(False)
    )


def redact_spans(text: Column, entities: Column) -> Column:
    """Replace spans found elsewhere by ``[TYPE]``, from the right.

    Spans are taken by falling begin offset, equal begins in list order, and each
    is cut from the text as the earlier ones left it.  Overlaps are therefore not
    resolved, as the callers of this rule expect.  Lists without overlaps, the
    usual kind, are put together from the pieces between the spans instead, which
    gives the same text without copying it for every span.
    """
    ordered = F.array_sort(entities, lambda left, right: left["begin"] - right["begin"])

    def either(spans: Column) -> Column:
        def separate(size: Column) -> Column:
            # Each span lies behind the one before it, and all begin inside the text.
            fits = F.zip_with(
                spans,
                F.slice(spans, 2, F.size(spans)),
                lambda a, b: (a["begin"] >= 0)
                & (a["end"] >= a["begin"])
                & (a["begin"] <= size)
                & F.coalesce((b["begin"] > a["begin"]) & (b["begin"] >= a["end"]), b.isNull()),
            )
            return F.forall(fits, lambda ok: F.coalesce(ok, F.lit(False)))

        whole = let(F.length(text), separate)
        return F.when(whole, _join_pieces(text, spans)).otherwise(_splice(text, entities))

    return F.when(F.size(entities) > 0, let(ordered, either)).otherwise(text)


def _splice(text: Column, entities: Column) -> Column:
    return F.aggregate(
        F.array_sort(entities, lambda left, right: right["begin"] - left["begin"]),
        text,
        lambda t, e: F.concat(
            F.substring(t, F.lit(1), e["begin"]),
            F.lit("["),
            e["type"],
            F.lit("]"),
            F.substring(t, e["end"] + 1, F.length(t)),
        ),
    )


BLOCK_CHARS = 1024


def _join_pieces(text: Column, spans: Column) -> Column:
    """The text with separate spans, sorted, replaced.

    Counting to the n-th character of a text walks over all before it, so the
    text is first cut into blocks and a piece taken from the blocks it lies in.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))

    def piece(blocks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / BLOCK_CHARS).cast("int")
        count = F.floor(end / BLOCK_CHARS).cast("int") - first + 1
        held = F.array_join(F.slice(blocks, first + 1, count), "")
        return F.substring(held, begin - first * BLOCK_CHARS + 1, F.greatest(end - begin, F.lit(0)))

    def joined(held: Column) -> Column:
        blocks, size = held["blocks"], held["size"]
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda e: F.least(e["end"], size)))
        pieces = F.zip_with(
            ends,
            spans,
            lambda end, e: F.concat(
                piece(blocks, end, F.coalesce(e["begin"], size)),
                F.when(e.isNull(), "").otherwise(F.concat(F.lit("["), e["type"], F.lit("]"))),
            ),
        )
        return F.array_join(pieces, "")

    return let(F.struct(blocks.alias("blocks"), F.length(text).alias("size")), joined)
