"""Text, label, JSON and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name the same kind of region.
SYNONYMS = {
    "table": ("table", "tabular"),
    "figure": ("figure", "graphic", "diagram", "illustration"),
    "image": ("image", "picture", "photo", "graphic", "figure"),
    "chart": ("chart", "graph", "plot", "diagram"),
}


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_label(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), "_-", "  ")


#: Names of a table, and words in the names of the other kinds, in the order of tests.
TABLES = ("bordered", "borderless", "table")
KINDS = {"chart": ("chart", "graph", "plot"), "figure": ("figure", "diagram", "illustration"), "image": ("image", "photo", "picture")}


def canonical_label(c: Column) -> Column:
    """table, chart, figure or image, in this order of tests; else the normalised label."""
    n = norm_label(c)
    out = F.when(n.isin(*TABLES), "table")
    for kind, (first, *rest) in KINDS.items():
        found = n.contains(first)
        for word in rest:
            found = found | n.contains(word)
        out = out.when(found, kind)
    return out.otherwise(n)


def label_matches(label: Column, wanted: list[str]) -> Column:
    """Whether a label has one of the wanted names, or a synonym of one, in it; with none wanted all do."""
    names = [w.strip().lower().translate(str.maketrans("_-", "  ")) for w in wanted]
    words = sorted({x for w in names for x in (w, *SYNONYMS.get(w, ()))})
    n = norm_label(label)
    out = F.lit(not words)
    for w in words:
        out = out | n.contains(w)
    return out


def modality(label: Column) -> Column:
    return F.when(norm_label(label).contains("table"), "table").otherwise("image")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def sentences(c: Column) -> Column:
    """Pieces of each line after . ! ? and white space; the whole text if there is none."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"(?<=[.!?])\s+"), strip)))
    kept = F.filter(parts, lambda p: p != "")
    whole = strip(F.coalesce(c, F.lit("")))
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def joined(order: str, text: str, separator: str) -> Column:
    """Aggregate: the texts that aren't blank, in order."""
    rows = F.array_sort(F.collect_list(F.when(strip(F.col(text)) != "", F.struct(F.col(order), strip(F.col(text)).alias("x")))))
    return F.array_join(F.transform(rows, lambda s: s["x"]), separator)


def node_context(node_type: Column, page: Column, label: Column, modality: Column, text: Column) -> Column:
    """What an embedder reads of a node: its facts, a line each, and its content or a placeholder.

    The names of the lines and the placeholder are fixed values.
    """
    kind = F.coalesce(F.nullif(F.lower(strip(node_type)), F.lit("")), F.lit("unknown"))
    named = lambda name, c: F.when(strip(c) != "", F.concat(F.lit(name + ": "), strip(c)))
    body = F.coalesce(F.nullif(strip(text), F.lit("")), F.lit("[EMPTY NODE CONTEXT]"))
    return F.concat_ws(
        "\n", F.concat(F.lit("Node type: "), kind), F.concat(F.lit("Page: "), page.cast("string")),
        F.when(kind == "region", named("Region label", label)), F.when(kind == "fine", named("Fine modality", modality)), F.lit("Content:"), body,
    )


def json_object(c: Column) -> Column:
    """The JSON object in free text (a fence and prose around it are dropped); null if there is none."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^```(?:json)?", "")), r"```$", ""))
    found = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def json_field(c: Column, field: str) -> Column:
    """A field of the object in free text, empty where the object has none; the whole text where there is no object."""
    found = json_object(c)
    filled = found.isNotNull() & (F.coalesce(F.json_object_keys(found), F.array().cast("array<string>")) != F.array().cast("array<string>"))
    return F.when(filled, strip(F.coalesce(F.get_json_object(found, f"$.{field}"), F.lit("")))).otherwise(strip(F.coalesce(c, F.lit(""))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, with cosine 0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (F.lit(1.0) + F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))) / 2
