"""Rule classifier over text, file name and entity labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.lookup import contains_any


def category(text: Column, labels: Column) -> Column:
    """Category by the first rule that holds; ``labels`` is an array of entity labels."""
    low = F.lower(text)

    def has(*names: str) -> Column:
        return F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))

    many_dates = F.size(F.filter(labels, lambda l: l == "date")) > 3
    return (F.when(contains_any(low, ["vertrag", "contract"]), "Arbeit")
            .when(contains_any(low, ["arbeits", "salary", "gehalt"]), "Arbeit")
            .when(has("iban", "tax_id"), "Finanzen").when(has("money"), "Finanzen")
            .when(has("email", "phone"), "Arbeit").when(many_dates, "Dokumente")
            .when(contains_any(low, ["arzt", "diagnose"]), "Gesundheit")
            .when(contains_any(low, ["versicher"]), "Finanzen").otherwise("Sonstiges"))


def main_entity(entities: Column, filename: Column) -> Column:
    """First organization, else first person, else the start of the file name; entities are
    ``array<struct<text,label>>``."""
    def first(label: str) -> Column:
        return F.get(F.filter(entities, lambda e: e["label"] == label), F.lit(0))["text"]

    return F.coalesce(first("organization"), first("person"), F.substring(filename, 1, 20))


def first_date(entities: Column) -> Column:
    return F.coalesce(F.get(F.filter(entities, lambda e: e["label"] == "date"), F.lit(0))["text"], F.lit(""))
