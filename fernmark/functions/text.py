"""Text predicates and clean-up of catalogue fields."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def normal_query(text: Column) -> Column:
    """Lower case, without apostrophes: how names are looked up."""
    return F.replace(F.lower(text), F.lit("'"), F.lit(""))


def matches_all_tokens(query: str, columns: list[Column]) -> Column:
    """Every token of the query is somewhere in one of the columns."""
    return _all([_any([F.contains(F.lower(c), F.lit(t)) for c in columns]) for t in query.lower().split()])


def _some_begins(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(word)))


def browse_matches(query: str, tokens: Column) -> Column:
    """Alternatives divided by "/", each a list of tokens that all begin some element of the array ``tokens``.

    Only the first run of characters that are no letters or spaces is removed
    from a token of the query, as users of the screens are used to.
    """
    found = []
    for alternative in query.lower().split("/"):
        words = re.sub(r"[^a-z ]+", "", alternative, count=1).split()
        if words:
            found.append(_all([_some_begins(tokens, w) for w in words]))
    return _any(found) if found else F.lit(True)


def has_word(text: Column, words: list[str]) -> Column:
    """One of the words, as a whole word of the lower-cased text."""
    return F.lower(text).rlike(r"\b(" + "|".join(map(re.escape, words)) + r")\b")


def license_parts(url: Column) -> tuple[Column, Column]:
    """(type, detail) of a licence address: the last two parts of its path; a lone part is both."""
    parts = F.filter(F.split(F.regexp_replace(url, r"^.*/licenses/", ""), "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))


def repaired_date(text: Column) -> Column:
    """A date whose unknown parts are 00 as the first of these; null if it is none, or before 1678."""
    fixed = F.regexp_replace(text, "-00", "-01")
    date = F.to_date(F.try_to_timestamp(F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2}$"), fixed), F.lit("yyyy-MM-dd")))
    return F.when(date >= F.lit("1678-01-01").cast("date"), date)


def hour_of(text: Column) -> Column:
    """Hour of a time such as 7:30 or 07h; null unless 0 to 23."""
    hour = F.regexp_extract(text, r"^\s*(\d{1,2})", 1).try_cast("int")
    return F.when(hour.between(0, 23), hour)


def place_parts(locality: Column, country: Column) -> dict[str, Column]:
    """"a, b, c": c is the state, a, b the place; both with their surroundings."""
    parts = F.transform(F.split(locality, ","), lambda p: F.trim(p))
    state = F.element_at(parts, -1)
    rest = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ", ")

    def joined(*cols: Column) -> Column:
        return F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in cols]), lambda c: c != ""), ", ")

    return {"state_only": state, "place_only": rest, "state": joined(state, country), "place": joined(rest, state, country)}


def abbreviated(place: Column, short: dict[str, str]) -> Column:
    """Parts of a place in reverse, the known ones abbreviated."""
    known = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    parts = F.transform(F.split(place, ","), lambda p: F.coalesce(F.try_element_at(known, F.trim(p)), F.trim(p)))
    return F.array_join(F.reverse(parts), ", ")


#: Entities of HTML that are put back. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Text of HTML: no tags, entities back, runs of white space as one space."""
    text = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def checklist_id(group: Column, event: Column) -> Column:
    """A group's id if there is one, else the event's, as a number: events without their S, groups negative."""
    return F.replace(F.replace(F.coalesce(group, event), F.lit("S"), F.lit("")), F.lit("G"), F.lit("-")).try_cast("long")


def source_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def source_parts(source: Column) -> tuple[Column, Column]:
    """Kind and key of "kind:key"."""
    return F.substring_index(source, ":", 1), F.when(F.contains(source, F.lit(":")), F.regexp_replace(source, "^[^:]*:", ""))


def snake_case(name: str) -> str:
    """A column name in snake case."""
    return re.sub(r"\W+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).strip("_").lower()


# Operation strings: "path.op(args).op(args)" name what was derived from a file.

_OP = r"\.([a-z_]+)\(([^()]*)\)"


def operations(audio: Column) -> Column:
    """The operations of an id, as "name(args)" in order."""
    return F.transform(F.regexp_extract_all(audio, F.lit(_OP), F.lit(0)), lambda o: F.substring(o, 2, 1 << 20))


def base_of(audio: Column) -> Column:
    return F.regexp_replace(audio, "(" + _OP + ")+$", "")


def simplified(audio: Column) -> Column:
    """Without an ``enc`` or ``resample`` that repeats the one before it, or ``enc(wav)`` of a .wav file."""
    base = base_of(audio)
    kept = F.aggregate(
        operations(audio),
        F.array().cast("array<string>"),
        lambda acc, o: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == o) & o.rlike(r"^(enc|resample)\("), acc)
        .when((F.size(acc) == 0) & (o == "enc(wav)") & base.endswith(".wav"), acc)
        .otherwise(F.concat(acc, F.array(o))),
    )
    return F.concat(base, F.array_join(F.transform(kept, lambda o: F.concat(F.lit("."), o)), ""))


def with_operation(audio: Column, op: str) -> Column:
    return simplified(F.concat(audio, F.lit("." + op)))


#: Media types by format. Fixed values.
MEDIA_TYPES = {"mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "audio/mp4", "png": "image/png"}


def format_of(audio: Column) -> Column:
    """Format of an id: what its last operation encodes to, or without operations its extension; else null."""
    ops = operations(audio)
    encoded = F.regexp_extract(F.try_element_at(ops, F.lit(-1)), r"^enc\(([^,)]+)", 1)
    return F.when(F.size(ops) == 0, F.substring_index(audio, ".", -1)).when(encoded != "", encoded)


def media_type(audio: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]), format_of(audio))


def is_noop(audio: Column, op: str) -> Column:
    """Whether an operation would leave an id as it is: a transcoder plans these away."""
    return with_operation(audio, op) == simplified(audio)


def rewritten(text: Column, rules: dict[str, str]) -> Column:
    """Regular expressions replaced one after another, as where the names of models' settings changed."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules.items(), text)


def sha1_key(*parts: Column) -> Column:
    """A key of several values; null counts as empty."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def background_species(background: Column, codes: Column) -> Column:
    """Entries such as "name (scientific name)" as the species' codes, by a map; unknown ones as they are, empty ones left out."""
    trimmed = F.filter(F.transform(background, lambda b: F.trim(b)), lambda b: b != "")
    return F.transform(trimmed, lambda b: F.coalesce(F.try_element_at(codes, F.regexp_extract(b, r"\(([^()]*)\)\s*$", 1)), b))


def merged_unique(lists: Column) -> Column:
    """The elements of several lists, each once, in the order in which they are first seen."""
    return F.array_distinct(F.flatten(lists))
