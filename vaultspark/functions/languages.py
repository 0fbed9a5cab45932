"""A census of languages by function words."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Function words of the built-in profiles; fixed values, in order.
BUILT_IN = {
    "en": "the and of to in is are for with that this as be on by an we it from will",
    "pt": (
        "o os um uma da das dos na nas ao aos à às num numa pelo pela pelos pelas neste nesta nesse nessa deste desta desse dessa "
        "de que em para com sem até sob após ou mas pois porém embora porque então é são foi foram tem têm ter tinha havia há pode podem "
        "deve devem seja sejam está seu sua seus suas nosso nossa nós qual quais outro outra outros outras qualquer mesmo mesma isso "
        "não mais muito ainda assim apenas bem como depois onde quando sempre sobre também já será através"
    ),
    "es": (
        "de que una para con como más está son también ya nosotros sobre será fue pero porque el la los las del esto un su sus hasta sin "
        "hay tiene tener cuando donde cual muy mucho bien siempre entonces aunque además esa ese"
    ),
}
BUILT_IN = {code: tuple(words.split()) for code, words in BUILT_IN.items()}
WORD = "[A-Za-zÀ-ÿ]+"
#: Hits that name a language; and notes, share and number of a vault's languages.
LEAST_HITS, LEAST_NOTES, LEAST_SHARE, MOST = 3, 3, 0.02, 3


def merged(extra: dict | None) -> dict[str, tuple[str, ...]]:
    """The built-in profiles with others over them: {code: {"stopwords": [...]}}, also under a key "profiles". What has no words is left out."""
    extra = (extra or {}).get("profiles", extra or {})
    out = dict(BUILT_IN)
    for code, spec in extra.items() if isinstance(extra, dict) else ():
        words = spec.get("stopwords") if isinstance(spec, dict) else None
        clean = sorted({str(w).strip().lower() for w in words if str(w).strip()}) if isinstance(words, list) else []
        if str(code).strip() and clean:
            out[str(code).strip().lower()] = tuple(clean)
    return out


def load_profiles(spark: SparkSession, path: str | None) -> dict[str, tuple[str, ...]]:
    """Profiles of a JSON file over the built-in ones; a text that is no JSON object changes nothing."""
    if not path:
        return merged(None)
    try:
        extra = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        extra = None
    return merged(extra if isinstance(extra, dict) else None)


def telling(profiles: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """The words of each profile that no other one has."""
    of = {}
    for code, words in profiles.items():
        for w in set(words):
            of.setdefault(w, []).append(code)
    return {code: sorted(w for w in set(words) if len(of[w]) == 1) for code, words in sorted(profiles.items())}


def language_of(text: str, profiles: dict[str, tuple[str, ...]]) -> Column:
    """The language with the most hits; 'unknown' below three hits or on a tie. Words of up to two capitals are no words.

    Words are counted in the row: nothing is exploded or shuffled."""
    told = telling(profiles)
    owner = {w: i for i, stop in enumerate(told.values(), 1) for w in stop}
    if not owner:
        return F.lit("unknown")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    known = F.filter(words, lambda w: F.lower(w).isin(*owner) & ((F.length(w) > 2) | (w != F.upper(w))))
    # one fold over the few words that tell: a count for each language
    number = F.create_map(*[F.lit(x) for pair in owner.items() for x in pair])
    add = lambda counts, w: F.transform(counts, lambda n, i: n + (i + 1 == F.element_at(number, F.lower(w))).cast("int"))

    def best(counts):
        most = F.array_max(counts)
        tie = F.size(F.filter(counts, lambda n: n == most)) > 1
        return F.when((most < LEAST_HITS) | tie, "unknown").otherwise(F.element_at(F.array(*map(F.lit, told)), F.array_position(counts, most).cast("int")))

    return F.aggregate(known, F.array_repeat(F.lit(0), len(told)), add, best)


def census(docs: DataFrame, profiles: dict[str, tuple[str, ...]], *, text: str = "text", most: int = MOST, least_share: float = LEAST_SHARE) -> DataFrame:
    """(lang_found, n, share, selected): notes of each language, its share of those that have one, and whether it is one of
    the vault's languages (enough notes and share, the most frequent first)."""
    n = docs.select(language_of(text, profiles).alias("lang_found")).groupBy("lang_found").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("lang_found") != "unknown"
    rows = n.withColumn("total", F.sum(F.when(known, F.col("n"))).over(Window.partitionBy()))
    share = F.when(known, F.col("n") / F.col("total"))
    fit = known & (F.col("n") >= LEAST_NOTES) & (share >= least_share)
    rows = rows.withColumns({"share": share, "fit": F.coalesce(fit, F.lit(False))})
    place = F.row_number().over(Window.partitionBy("fit").orderBy(F.desc("n"), "lang_found"))
    return rows.select("lang_found", "n", F.round("share", 4).alias("share"), (F.col("fit") & (place <= most)).alias("selected"))
