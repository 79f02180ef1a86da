"""Advice on schema drafts: canonical fields, near matches, similar schemas, and integrity of the vocabulary.

Drafts and vocabularies are DataFrames of fields, so one run advises any number of drafts. Near matches meet by normalised
name or by normalised description, which are equi-joins; no pair is scored that shares neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEAR, SIMILAR = 3, 3

# fixed values: names that mean the same, spellings of units, and qualifiers that exclude each other
ALIASES = {
    "mime_type": "file_media_type", "file_mime_type": "file_media_type", "person_surname": "person_family_name", "person_last_name": "person_family_name",
    "birth_date": "date_of_birth", "person_birthdate": "date_of_birth", "person_birth_date": "date_of_birth", "contact_email": "contact_email_address",
    "person_identifier": "person_id", "directory_person_id": "person_id", "directory_person_identifier": "person_id", "contact_invite_code": "contact_code",
    "contact_invitation_code": "contact_code", "contact_invitation_token": "contact_code", "profile_display_name": "display_name", "profile_display_label": "display_name",
}
UNITS = {
    "degree": "degrees", "radian": "radians", "ms": "milliseconds", "millisecond": "milliseconds", "second": "seconds", "minute": "minutes", "hour": "hours",
    "byte": "bytes", "bit": "bits", "px": "pixels", "pixel": "pixels", "inch": "inches", "cm": "centimeters", "centimeter": "centimeters",
    "centimetre": "centimeters", "centimetres": "centimeters", "mm": "millimeters", "millimeter": "millimeters", "millimetre": "millimeters",
    "millimetres": "millimeters", "km": "kilometers", "kilometer": "kilometers", "kilometre": "kilometers", "kilometres": "kilometers",
}
QUALIFIERS = [
    "created updated deleted sent received taken", "start end", "source target destination", "minimum maximum", "first last", "public private",
    "latitude longitude", "preparation cooking cooling", "seconds milliseconds microseconds minutes hours days", "bytes bits", "degrees radians",
    "pixels inches feet centimeters millimeters meters kilometers",
]
FILLERS = ["a", "an", "the", "and", "for", "to", "of"]
CONNECTIVES = ["of", "to", "by", "in", "at", "for", "and", "the"]
VAGUE = ["generic", "entity", "item"]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _replaced(word: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[word], word)


def name_words(name: Column) -> Column:
    """Words of a field name: camel case split, units spelled out, a word repeated at once counted once."""
    split = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu})(?=\p{Ll})", "$1_$2")
    spelled = F.transform(words(split), lambda w: _replaced(w, UNITS))
    kept = F.filter(spelled, lambda w, i: (i == 0) | (w != F.get(spelled, i - 1)))
    return F.when((F.size(kept) == 2) & (F.get(kept, F.lit(0)) == "id"), F.reverse(kept)).otherwise(kept)


def normal_name(name: Column) -> Column:
    return _replaced(F.array_join(name_words(name), "_"), ALIASES)


def description_words(text: Column) -> Column:
    """Words of a description that carry meaning, in one spelling."""
    raw = words(text)
    raw = F.filter(raw, lambda w, i: ~((w == "assigned") & F.coalesce(F.get(raw, i + 1) == "to", F.lit(False)) & F.coalesce(F.get(raw, i - 1).isin("id", "identifier"), F.lit(False))))
    kept = F.transform(F.filter(raw, lambda w: ~w.isin(*FILLERS)), lambda w: F.when(w == "identifier", "id").otherwise(_replaced(w, UNITS)))
    return F.split(F.replace(F.concat(F.lit(" "), F.array_join(kept, " "), F.lit(" ")), F.lit(" stable opaque "), F.lit(" opaque stable ")), " ")


def descriptions_agree(a: Column, b: Column) -> Column:
    return (words(a) == words(b)) | ((F.size(description_words(a)) >= 4) & (description_words(a) == description_words(b)))


def qualifiers_conflict(a: Column, b: Column) -> Column:
    """Whether two word lists name different members, and no common one, of a group of qualifiers."""
    out = F.lit(False)
    for group in QUALIFIERS:
        members = F.array(*[F.lit(w) for w in group.split()])
        mine, other = F.array_intersect(a, members), F.array_intersect(b, members)
        out |= (F.size(mine) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(mine, other)
    return out


def near_matches(drafts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Up to NEAR vocabulary fields for each draft field that isn't in the vocabulary: draft, name, other, score, place.

    drafts: draft, name, type, description; vocabulary: name, type, description. Score 2: names agree once normalised; 1:
    only the descriptions do. Types given must agree, descriptions given must agree, qualifiers must not conflict.
    """
    v = vocabulary.select(F.col("name").alias("other"), F.col("type").alias("v_type"), F.col("description").alias("v_description"), normal_name(F.col("name")).alias("v_normal"), name_words(F.col("name")).alias("v_words"), F.array_join(description_words(F.col("description")), " ").alias("v_meaning"), F.array_join(words(F.col("description")), " ").alias("v_text"))
    d = drafts.join(vocabulary.select("name"), "name", "left_anti")
    d = d.withColumns({"_normal": normal_name(F.col("name")), "_words": name_words(F.col("name")), "_meaning": F.array_join(description_words(F.col("description")), " "), "_text": F.array_join(words(F.col("description")), " ")})
    given = F.trim(F.coalesce("description", F.lit(""))) != ""
    fits = (F.col("type").isNull() | (F.col("type") == F.col("v_type"))) & (~given | descriptions_agree(F.col("description"), F.col("v_description"))) & ~qualifiers_conflict(F.col("_words"), F.col("v_words"))
    by_name = d.join(v, F.col("_normal") == F.col("v_normal")).where(fits).withColumn("score", F.lit(2))
    by_text = d.where(given).join(v, (F.col("_meaning") == F.col("v_meaning")) & (F.col("_normal") != F.col("v_normal"))).where(fits).withColumn("score", F.lit(1))
    same_text = d.where(given).join(v, (F.col("_text") == F.col("v_text")) & (F.col("_normal") != F.col("v_normal")) & (F.col("_meaning") != F.col("v_meaning"))).where(fits).withColumn("score", F.lit(1))
    columns = ["draft", "name", "other", "score"]
    found = by_name.select(*columns).union(by_text.select(*columns)).union(same_text.select(*columns)).distinct()
    best = Window.partitionBy("draft", "name").orderBy(F.desc("score"), "other")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= NEAR)


def canonical_findings(drafts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each draft field that has a vocabulary field's name: whether it means the same, and where it differs."""
    v = vocabulary.select("name", F.col("type").alias("v_type"), F.col("description").alias("v_description"), F.col("version").alias("v_version"))
    x = drafts.join(v, "name")
    parts = [F.when(F.col("type") != F.col("v_type"), "type"), F.when(F.col("description").isNotNull() & ~descriptions_agree(F.col("description"), F.col("v_description")), "description"), F.when(F.coalesce("version", F.lit(1)) != F.col("v_version"), "version")]
    differs = F.array_compact(F.array(*parts))
    kind = F.when(F.size(differs) > 0, "same_name_different_meaning").otherwise("canonical_match")
    exact = (F.size(differs) == 0) & F.col("type").isNotNull() & F.coalesce(words(F.col("description")) == words(F.col("v_description")), F.lit(False))
    return x.select("draft", "name", kind.alias("kind"), F.array_join(differs, ",").alias("differs"), exact.alias("exact"))


def missing_types(drafts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Draft fields without a type, and the type that the vocabulary suggests."""
    bare = drafts.where("type IS NULL")
    own = vocabulary.select("name", F.col("type").alias("_own"), F.col("description").alias("_d"))
    near = near_matches(bare, vocabulary).where("place = 1").join(vocabulary.select(F.col("name").alias("other"), F.col("type").alias("_near")), "other").select("draft", "name", "_near")
    meaning = F.col("description").isNull() | F.col("_d").isNull() | (F.trim("description") == "") | descriptions_agree(F.col("description"), F.col("_d"))
    x = bare.join(own, "name", "left").join(near, ["draft", "name"], "left")
    return x.select("draft", "name", F.coalesce(F.when(meaning, F.col("_own")), "_near").alias("suggested_type"))


def suggested_classifications(drafts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Draft fields without a classification whose vocabulary field, meant the same, has one: draft, name, suggested_classification."""
    known = vocabulary.where("classification IS NOT NULL").select("name", F.col("description").alias("_d"), F.col("classification").alias("suggested_classification"))
    same = F.col("description").isNull() | (F.trim("description") == "") | F.col("_d").isNull() | descriptions_agree(F.col("description"), F.col("_d"))
    return drafts.where("classification IS NULL").join(known, "name").where(same).select("draft", "name", "suggested_classification")


def name_fault(name: Column, short_words: list[str], abbreviations: list[str]) -> Column:
    """What is wrong with a new canonical field name; null if nothing is."""
    parts = F.split(name, "_")
    any_ = lambda f: F.exists(parts, f)
    psi = F.array_join(F.slice(parts, -2, 2), "_") == "pressure_psi"
    known = F.exists(parts, lambda w: w.isin(*abbreviations) & ~((w == "psi") & psi)) if abbreviations else F.lit(False)
    return (
        F.when((F.octet_length(name) > 96) | (name == ""), "length")
        .when(any_(lambda w: ~w.rlike("^[a-z][a-z0-9]*$")), "form")
        .when(F.size(F.filter(parts, lambda w: ~w.isin(*CONNECTIVES))) < 2, "one concept")
        .when(any_(lambda w: F.length(w) == 1), "one letter")
        .when(any_(lambda w: (F.length(w) == 2) & ~w.isin(*short_words)), "short word")
        .when(known, "abbreviation")
        .when(any_(lambda w: w.isin(*VAGUE)), "vague")
    )


def vocabulary_faults(vocabulary: DataFrame) -> DataFrame:
    """Fields of a vocabulary that break its rules: repeated names, thin descriptions, descriptions of another field."""
    said = F.array_join(words(F.col("description")), " ")
    x = vocabulary.select("name", "description", said.alias("said"))
    names = x.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("name").alias("fault"))
    thin = x.where((F.size(F.split("said", " ")) < 3) | (F.octet_length("description") > 4096) | F.col("description").isNull()).select("name", F.lit("description").alias("fault"))
    twice = x.groupBy("said").agg(F.count("*").alias("n")).where("n > 1 AND said <> ''").select("said")
    return reduce(DataFrame.union, [names, thin, x.join(twice, "said", "left_semi").select("name", F.lit("duplicate").alias("fault"))])


def similar_schemas(fields: DataFrame, most: int = SIMILAR) -> DataFrame:
    """For each schema the `most` others that share at least two fields and half of its own: schema, other, shared, score, place.

    fields: schema, field (normalised). The score is 1024 times shared over united fields. Pairs arise only where a field is
    shared and are counted, not listed.
    """
    f = fields.select("schema", "field").distinct()
    sizes = f.groupBy("schema").agg(F.count("*").alias("size"))
    # who shares at least m = max(2, half) of a schema's n fields shares one of its n - m + 1 rarest: pairs meet only there, so a
    # field that all schemas have pairs none that have enough rarer ones
    rare = Window.partitionBy("schema").orderBy("times", "field")
    ranked = f.join(f.groupBy("field").agg(F.count("*").alias("times")), "field").join(sizes, "schema").withColumn("nth", F.row_number().over(rare))
    probe = ranked.where(F.expr("size >= 2 AND nth <= size - greatest(2, (size + 1) div 2) + 1")).select("schema", "field")
    other = f.select(F.col("schema").alias("other"), "field")
    pairs = probe.join(other, "field").where("schema <> other").select("schema", "other").distinct()
    shared = pairs.join(f, "schema").join(other, ["other", "field"]).groupBy("schema", "other").agg(F.count("*").alias("shared"))
    x = shared.join(sizes, "schema").join(sizes.select(F.col("schema").alias("other"), F.col("size").alias("other_size")), "other")
    x = x.where("shared >= 2 AND shared * 2 >= size").withColumn("score", F.expr("shared * 1024 div (size + other_size - shared)"))
    best = Window.partitionBy("schema").orderBy(F.desc("score"), F.desc("shared"), "other")
    return x.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("schema", "other", "shared", "score", "place")


def admitted(fields: DataFrame, policy: DataFrame) -> DataFrame:
    """Shared fields (namespace, field) that a policy's allow-list lets in; a null field in the policy allows a whole namespace."""
    whole = policy.where("field IS NULL").select("namespace").distinct()
    some = policy.where("field IS NOT NULL").select("namespace", "field").distinct()
    return fields.join(whole, "namespace", "left_semi").union(fields.join(whole, "namespace", "left_anti").join(some, ["namespace", "field"], "left_semi"))
