"""String functions of the pipeline as column expressions; all run inside the JVM."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: white space in the sense of Python's str.strip, which is wider than Spark's trim.
BLANK = r"[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def normal_name(c: Column) -> Column:
    """An entity's name as it is compared: stripped and in lower case."""
    return F.lower(strip(c))


def page_key_doc(key: Column) -> Column:
    return F.when(key.rlike(r"(?s)^.+?_\d+$"), F.regexp_extract(key, r"(?s)^(.+?)_(\d+)$", 1)).otherwise(key)


def page_key_index(key: Column) -> Column:
    return F.when(key.rlike(r"(?s)^.+?_\d+$"), F.regexp_extract(key, r"(?s)^(.+?)_(\d+)$", 2).cast("int")).otherwise(0)


def quoted(name: Column) -> Column:
    """A pattern that matches ``name`` literally."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_word(text: Column, name: Column) -> Column:
    """Whether ``name`` stands in ``text`` between non-word characters; the cheap test comes first."""
    return F.contains(text, name) & F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted(name), F.lit(r"(?!\w)")))


def point_id(natural: Column) -> Column:
    """UUID spelled from the first 32 hex digits of the natural id's SHA-1."""
    h = F.sha1(natural)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def citation_tags(content: Column) -> Column:
    """Distinct tags such as S1 that stand alone in brackets, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?U)\[(S\d+)\]"), F.lit(1))))


def answer_of(content: Column) -> Column:
    """What follows the last "answer:" in any case; everything when there is none."""
    last = F.regexp_extract(content, r"(?is)^.*answer:(.*)$", 1)
    return strip(F.when(content.rlike(r"(?i)answer:"), last).otherwise(content))


def reasoning_of(content: Column) -> Column:
    """What precedes the last "answer:", without "reasoning:" headings; empty when there is no answer."""
    before = F.regexp_extract(content, r"(?is)^(.*)answer:.*$", 1)
    return F.when(content.rlike(r"(?i)answer:"), strip(F.regexp_replace(before, r"(?i)reasoning:", ""))).otherwise("")


def judge_score(reply: Column) -> Column:
    """First unsigned number in a judge's reply, between 0 and 1; null without one."""
    number = F.regexp_substr(reply, F.lit(r"\d*\.?\d+")).cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def triples(reply: Column) -> Column:
    """array<struct<subject,relation,object>> from a reply that holds a JSON list of objects.

    The slice from the first "[" to the last "]" is parsed; invalid JSON gives an empty array, elements
    that aren't objects or lack a field, or have a blank one, are dropped, and a JSON null reads as the
    word None.
    """
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    rows = F.try_parse_json(body).try_cast("array<variant>") if hasattr(Column, "try_cast") else F.try_parse_json(body).cast("array<variant>")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")

    def value(v: Column, name: str) -> Column:
        found = F.try_variant_get(v, f"$.{name}", "string")
        whole = F.concat(F.lit('"'), F.lit(name), F.lit('":null'))
        return strip(F.when(found.isNull() & F.contains(F.to_json(v), whole), F.lit("None")).otherwise(found))

    made = F.transform(
        F.filter(rows, lambda v: v.isNotNull() & is_object(v)),
        lambda v: F.struct(value(v, "subject").alias("subject"), value(v, "relation").alias("relation"), value(v, "object").alias("object")),
    )
    full = F.filter(made, lambda t: (F.coalesce(t["subject"], F.lit("")) != "") & (F.coalesce(t["relation"], F.lit("")) != "") & (F.coalesce(t["object"], F.lit("")) != ""))
    return F.coalesce(full, F.array().cast("array<struct<subject:string,relation:string,object:string>>"))


def clean_question(reply: Column) -> Column:
    return F.btrim(strip(reply), F.lit('"'))


def mentions(question: Column, name: Column) -> Column:
    return F.contains(F.lower(question), F.lower(name))


def _least_rounded_up() -> list[float]:
    """For each tenth, the least double in [0, 1) that is nearer to the next one; of the two exact ties 0.25 goes down and 0.75 up."""
    out = []
    for n in range(10):
        middle = Fraction(2 * n + 1, 20)
        near = float(middle)
        up = Fraction(near) > middle or (Fraction(near) == middle and n % 2 == 1)
        out.append(near if up else math.nextafter(near, 1.0))
    return out


LEAST_ROUNDED_UP = _least_rounded_up()


def one_digit(value: Column) -> Column:
    """``value`` with one digit as C prints it: of the double's exact value, ties to the even digit. Java rounds the shortest decimal text, ties up."""
    size = F.abs(value)
    part = size - F.floor(size)  # exact
    tenths = F.floor(size) * 10 + sum((part >= x).cast("long") for x in LEAST_ROUNDED_UP)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_duration(seconds: Column) -> Column:
    """7.4s, 1m 05s, 1h 02m 03s."""
    whole = F.floor(seconds).cast("int")
    h, m, s = F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60
    return (
        F.when(seconds < 60, F.concat(one_digit(seconds), F.lit("s")))
        .when(h == 0, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%dh %02dm %02ds", h, m, s))
    )


def plain_duration(seconds: Column) -> Column:
    """5s, 1m 5s, 2h 14m 33s."""
    whole = F.floor(seconds).cast("int")
    h, m, s = F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def evidence_block(items: Column) -> Column:
    """Numbered evidence for a prompt from array<struct<doc_id,page_index,modality,text>>."""
    one = lambda x, i: F.concat(
        F.lit("[S"), (i + 1).cast("string"), F.lit("] (doc "), x["doc_id"], F.lit(", page "), x["page_index"].cast("string"), F.lit(", "), x["modality"], F.lit(")\n"), strip(x["text"])
    )
    return F.array_join(F.transform(items, one), "\n\n")


def source_id(item: Column, place: Column) -> Column:
    """What a citation of an item points to; items without ids are named by their place from 1."""
    empty = lambda c: F.when(c != "", c)
    return F.coalesce(empty(item["chunk_id"]), empty(item["region_id"]), F.concat(F.lit("item-"), place.cast("string")))


def citations(content: Column, items: Column) -> Column:
    """Source ids of the cited evidence, in the order of their sorted tags; unknown tags drop out."""
    tags = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("tag"), source_id(x, i + 1).alias("id")))
    known = F.map_from_entries(tags)
    found = F.transform(citation_tags(content), lambda t: F.try_element_at(known, t))
    return F.filter(found, lambda x: x.isNotNull())


SYSTEM_PROMPT = (
    "You answer questions about scientific documents from the numbered evidence alone. "
    "Cite each claim with its tag, such as [S1], and say so when the evidence does not suffice."
)


def user_prompt(question: Column, evidence: Column, step_by_step: bool = True) -> Column:
    ask = "Think it through under 'Reasoning:', then give the result under 'Answer:'." if step_by_step else "Give only the result, under 'Answer:'."
    return F.concat(F.lit("Evidence:\n"), evidence, F.lit("\n\nQuestion: "), question, F.lit("\n\n" + ask))


def path_text(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat(subject, F.lit(" --"), relation, F.lit("--> "), obj)


def crop_file(directory: str, region_id: Column) -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), F.replace(region_id, F.lit(":"), F.lit("_")), F.lit(".png"))


def upscaled(width: Column, height: Column, least: int = 896) -> Column:
    """struct(width, height) with the long side at ``least`` pixels or more, half-even rounding."""
    scale = least / F.greatest(width, height)
    fit = lambda x: F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int"))
    small = F.greatest(width, height) < least
    return F.struct(F.when(small, fit(width)).otherwise(width).alias("width"), F.when(small, fit(height)).otherwise(height).alias("height"))
