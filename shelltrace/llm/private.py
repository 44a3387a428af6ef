"""Surrogates for personal data.

Entities are found by patterns, longest alternatives first. Each distinct
entity of a type gets one surrogate, so that mentions of it stay the same, and
distinct entities get distinct ones:

* The surrogate is drawn from a hash of a secret key, the type, the entity and
  an attempt. It keeps the format: a digit becomes a digit, a letter a letter
  of its case, all else stays. IP addresses keep to numbers up to 255 and card
  numbers to their leading digit and check digit, phone numbers their country
  code. Names after a title are drawn from lists of its gender; names in other
  scripts than Latin get letters of the range that each letter is from, or
  Latin ones where its range is short.
* A name is each word of the run of names after a title, with inner capitals,
  hyphens and apostrophes; initials and particles between them stay. Within a
  document all mentions of such a word are the name, with a title or without.
* Surrogates are checked together: one that two entities of a type share goes
  to the smaller of them, one that is itself an entity to none. The others try
  again, until no collision is left.
* Documents get their entities' surrogates in one join and are put together
  from the pieces between entities.

Corner cases: a null text stays null; a text without entities stays as it is;
e-mail addresses are one entity whatever their case and keep none of it; rows
that repeat get equal texts. Ids may be null, repeat, and have any type.
Columns other than the text are passed through; ``n_entities`` is replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import text_key
from shelltrace.session import cut_lineage, write_through

# The forms of entities, titles and names. Repetitions are
# possessive, and an address begins where no other could, so that a text is
# searched in one pass and without a stack however long its words are.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "phone": r"(?<![\w+])\+\d{1,3} ?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,3}(?!\d)",
    "card": r"(?<!\w)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "secret": r"\bAKIA[0-9A-Z]{12,16}\b|(?<=password=)\w{6,}|(?<=token = \")\w{16,}(?=\")",
}
#: Titles that a name follows, and one word of a name.
TITLES = {
    "man": r"(?<=\b(?:Mr|Herr|Sr)\b\.? )",
    "woman": r"(?<=\b(?:Mrs|Ms|Frau|Mme|Sra)\b\.? )",
}
_NAME = (
    r"(?:\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)++"
    r"|\p{Lu}[\p{L}\p{M}]++|\p{Lo}[\p{L}\p{M}]*+)"
)
_PART = rf"(?:(?:\p{{Lu}}\. ?)|(?:van|von|der|den|de|da|dos|di|du|la|le|al|el|bin|ibn|zu|zur) )*+{_NAME}"
_RUN = rf"{_PART}(?: {_PART})*+"
NAMES = {
    "man": "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noel Otto Paul".split(),
    "woman": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
}
_KINDS = list(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _ranges(least: int = 16) -> list[tuple[int, int]]:
    """``(first, size)`` of runs of letters of one sort beyond Latin-1."""
    sorts = ((c, unicodedata.category(chr(c))) for c in range(0x100, 0x10000))
    runs = (list(run) for _, run in groupby(sorts, lambda x: x[1]))
    return [(r[0][0], len(r)) for r in runs if r[0][1] in ("Lu", "Ll", "Lo") and len(r) >= least]


#: Where letters have a range of their own, by code point.
_BLOCKS = _ranges()
#: The session setting that holds the key of a deployment.
KEY_SETTING = "spark.shelltrace.surrogates.key"


def _kind(entity: Column) -> Column:
    """The first type whose whole form ``entity`` has."""
    def whole(kind: str) -> Column:
        return entity.rlike(rf"^(?:{PATTERNS[kind]})$")

    found = F
    for kind in _KINDS[:-1]:
        found = found.when(whole(kind), kind)
    # What precedes a secret is no part of it.
    return found.otherwise(_KINDS[-1])


def _normal(entity: Column) -> Column:
    return F.when(entity.contains("@"), F.lower(entity)).otherwise(entity)


def _drawn(seed: Column, i: Column, n: Column) -> Column:
    """A number below ``n`` for place ``i``."""
    return F.pmod(F.xxhash64(seed, i), n).cast("int")


def _same_form(entity: Column, seed: Column) -> Column:
    """``entity`` with other letters and digits of the same sorts."""
    listed = json.dumps([{"first": first, "size": size} for first, size in _BLOCKS])
    blocks = F.from_json(F.lit(listed), "array<struct<first:int,size:int>>")

    def letter(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c.between("0", "9"), _drawn(seed, i, F.lit(10)).cast("string"))
        out = out.when(c.between("a", "z"), F.char(_drawn(seed, i, F.lit(26)) + 97))
        out = out.when(c.between("A", "Z"), F.char(_drawn(seed, i, F.lit(26)) + 65))
        accented = F.lit("àáâäèéêëìíîïòóôöùúûü")
        out = out.when(
            c.between("à", "ÿ"), F.substring(accented, _drawn(seed, i, F.lit(20)) + 1, F.lit(1))
        )
        # A table rather than a choice per range, which would be a large plan.
        own = F.filter(
            blocks, lambda b: code.between(b["first"], b["first"] + b["size"] - 1)
        )
        block = F.get(own, F.lit(0))
        drawn = F.lpad(F.hex(_drawn(seed, i, block["size"]) + block["first"]), 4, "0")
        other = F.when(F.size(own) > 0, F.decode(F.unhex(drawn), "UTF-16BE"))
        # Other letters have too few like them.
        other = other.when(c.rlike(r"^\p{Lu}"), F.char(_drawn(seed, i, F.lit(26)) + 65))
        other = other.when(c.rlike(r"^\p{L}"), F.char(_drawn(seed, i, F.lit(26)) + 97))
        return out.when(code > 127, other.otherwise(c)).otherwise(c)

    # The empty pattern splits between characters.
    return F.array_join(F.transform(F.split(entity, ""), letter), "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    turned = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 0, twice).otherwise(n)

    total = F.aggregate(F.transform(turned, worth), F.lit(0), lambda s, x: s + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def surrogate(kind: Column, entity: Column, seed: Column, attempt: Column) -> Column:
    """The replacement that ``seed`` draws, a column that holds it.

    An expression would be worked out anew for every letter.
    """
    form = _same_form(entity, seed)
    numbers = F.transform(
        F.split(entity, r"\."), lambda x, i: _drawn(seed, i, F.lit(254)) + 1
    )
    ip = F.array_join(numbers.cast("array<string>"), ".")
    # The last digit makes the sum right; separators stay where they are.
    body = F.concat(F.substring(entity, 1, 1), F.substring(form, F.lit(2), F.length(entity) - 2))
    card = F.concat(body, _luhn(F.regexp_replace(body, r"\D", "")))
    code = F.regexp_extract(entity, r"^\+\d{1,3}", 0)
    phone = F.concat(code, F.substring(form, F.length(code) + 1, F.length(form)))
    at = F.regexp_extract(form, r"^[^@]*@", 0)
    email = F.concat(at, F.regexp_extract(form, r"@(.*)$", 1))
    aws = F.concat(F.lit("AKIA"), F.substring(form, F.lit(5), F.length(form)))
    named = kind
    pick = F.lit(None).cast("string")
    for gender, names in NAMES.items():
        listed = F.element_at(
            F.array(*[F.lit(n) for n in names]), _drawn(seed, F.lit(0), F.lit(len(names))) + 1
        )
        # Beyond the list, names are made longer until they are distinct.
        longer = F.concat(listed, F.substring(F.lower(_same_form(entity, seed)), F.lit(1), attempt))
        pick = F.when(
            (named == gender) & entity.rlike(r"^\p{IsLatin}+$"),
            F.when(attempt > 0, longer).otherwise(listed),
        ).otherwise(pick)
    # Short names have few forms.
    grown = F.concat(form, F.substring(_same_form(F.repeat(entity, 9), seed), F.lit(1), attempt - 9))
    form = F.when(kind.isin(*NAMES) & (attempt > 9), grown).otherwise(form)
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "email", email)
        .when(entity.startswith("AKIA"), aws)
        .otherwise(F.coalesce(pick, form))
    )


def names_of(text: Column, kind: str) -> Column:
    """Distinct words of the names after a title of ``kind``."""
    runs = F.regexp_extract_all(text, F.lit(TITLES[kind] + _RUN), F.lit(0))
    words = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(_NAME), F.lit(0))))
    return F.when(text.rlike(TITLES[kind]), F.array_distinct(words)).otherwise(
        F.array().cast("array<string>")
    )


def _pattern(names: Column) -> Column:
    """The form of any entity of a text with these names, longest first."""
    ranked = F.transform(names, lambda n: F.struct(-F.length(n), n.alias("n")))
    listed = F.transform(F.array_sort(ranked), lambda x: x["n"])
    spaced = F.filter(listed, lambda n: ~n.rlike(r"^\p{Lo}"))
    dense = F.filter(listed, lambda n: n.rlike(r"^\p{Lo}"))
    letter = r"[\p{L}\p{M}\p{N}_]"
    return F.concat(
        F.lit(_ANY),
        F.when(
            F.size(spaced) > 0,
            F.concat(
                F.lit(f"|(?<!{letter})(?:"), F.array_join(spaced, "|"), F.lit(f")(?!{letter})")
            ),
        ).otherwise(""),
        # Scripts without case may do without blanks.
        F.when(F.size(dense) > 0, F.concat(F.lit("|"), F.array_join(dense, "|"))).otherwise(""),
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind entity surrogate`` for distinct ``(kind, entity)``.

    Rounds go on until no surrogate is taken twice or is an entity; from round
    to round only the entities that collided are left, a share that falls with
    the number of free forms.
    """
    left = entities.select("kind", "entity")
    taken = None
    attempt = 0
    real = left.select("kind", F.col("entity").alias("surrogate"))
    while True:
        seed = F.concat_ws("\x1f", F.lit(key), "kind", "entity", F.lit(str(attempt)))
        tried = cut_lineage(
            left.withColumn("_seed", F.sha2(seed, 256))
            .withColumn(
                "surrogate",
                surrogate(F.col("kind"), F.col("entity"), F.col("_seed"), F.lit(attempt)),
            )
            .drop("_seed")
        )
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won = won.select("kind", "entity", "surrogate")
        taken = cut_lineage(won if taken is None else taken.unionByName(won))
        left = cut_lineage(left.join(taken, ["kind", "entity"], "left_anti"))
        if left.isEmpty():
            return taken
        attempt += 1
        if attempt > 200:
            raise RuntimeError("some forms have too few surrogates for their entities")


def replace_private(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities``.

    Whoever has ``key`` can tell which surrogate an entity has, so it is kept
    with the deployment and not with the code.
    """
    women, men = names_of(F.col(text_col), "woman"), names_of(F.col(text_col), "man")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        text_key(F.col(text_col)).alias("_key"),
        F.col(text_col).alias("_text"),
        women.alias("_women"),
        men.alias("_men"),
    ).select("_id", "_key", F.explode(_mentions(F.col("_text"), distinct=True)).alias("m"))
    mentions = write_through(
        rows.select("_id", "_key", F.col("m.kind").alias("kind"), F.col("m.entity").alias("entity"))
        .distinct(),
        "private-mentions",
    )
    drawn = write_through(
        surrogates(mentions.select("kind", "entity").distinct(), key), "surrogates"
    )
    maps = (
        mentions.join(drawn, ["kind", "entity"])
        .groupBy("_id", "_key")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "entity"), "surrogate"))
            ).alias("_map")
        )
    )
    found = F.transform(
        _mentions(F.col(text_col)),
        lambda m: F.element_at("_map", F.concat_ws("\x1f", m["kind"], m["entity"])),
    )
    gaps = F.split(F.col(text_col), _pattern(F.concat("_women", "_men")))
    whole = F.concat(
        F.array_join(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, s: F.array(g, s))), ""),
        F.element_at(gaps, -1),
    )
    kept = [c for c in docs.columns if c != "n_entities"]
    key2 = text_key(F.col(text_col))
    marked = docs.select(*kept, key2.alias("_key2"), women.alias("_women"), men.alias("_men"))
    joined = marked.join(
        maps, (F.col("_key2") == F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_id")), "left"
    )
    touched = F.col("_map").isNotNull()
    return joined.select(
        *[
            F.when(touched, whole).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
            for c in kept
        ],
        F.when(touched, F.size(found)).otherwise(F.lit(0)).cast("long").alias("n_entities"),
    )


def _mentions(text: Column, distinct: bool = False) -> Column:
    """``(kind, entity)`` of each match; ``_women`` and ``_men`` hold the names."""
    def typed(e: Column) -> Column:
        kind = (
            F.when(F.array_contains("_women", e), "woman")
            .when(F.array_contains("_men", e), "man")
            .otherwise(_kind(e))
        )
        return F.struct(kind.alias("kind"), _normal(e).alias("entity"))

    found = F.regexp_extract_all(text, _pattern(F.concat("_women", "_men")), F.lit(0))
    # Texts are told apart by hash; pairs would be compared one by one.
    return F.transform(F.array_distinct(found) if distinct else found, typed)
