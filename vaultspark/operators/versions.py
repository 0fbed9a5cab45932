"""Links between versions of one document: names, markers, candidate pairs and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.operators.search import dot

#: Words before a version's number, and words that are a version; fixed values.
NUMBERED = "revisión|revisão|revisao|revision|versión|versão|versao|version|rev|ver|v"
RANKED = {"draft": 0, "rascunho": 0, "borrador": 0, "final": 100, "vf": 100}
DROPPED = "clean|copy|comentada|marked up"
#: Partners of a note, the newest first; and pairs looked at in one run.
PARTNERS, PAIRS = 25, 200
KEYS = ("conversation", "sender", "stem")


def spaced(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def marker(name: Column) -> Column:
    """(scale, n) of a name's version mark, or null: the last number after a version word, else a word's rank."""
    text = spaced(name)
    nums = F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?:{NUMBERED}) ?([0-9]{{1,3}})(?![\p{{L}}\p{{N}}])"), F.lit(1))
    words = F.split(text, " ")
    word = F.lit(None).cast("int")
    for w, n in reversed(RANKED.items()):
        word = F.when(F.array_contains(words, w), n).otherwise(word)
    last = F.try_element_at(nums, F.lit(-1)).cast("int")
    return F.when(last.isNotNull(), F.struct(F.lit("num").alias("scale"), last.alias("n"))).when(word.isNotNull(), F.struct(F.lit("word").alias("scale"), word.alias("n")))


def stem(name: Column) -> Column:
    """A name without extension, copy mark, date and version marks; null if fewer than four characters are left."""
    x = F.regexp_replace(F.lower(F.trim(name)), r"\.[a-z0-9]{1,5}$", "")
    x = F.regexp_replace(F.regexp_replace(x, r" *\([0-9]+\)$", " "), r"\d{4}-\d{2}-\d{2}", " ")
    gone = rf"(?<!\S)(?:(?:{NUMBERED}) ?[0-9]{{1,3}}|{'|'.join(RANKED)}|{DROPPED})(?!\S)"
    x = F.trim(F.regexp_replace(F.regexp_replace(spaced(x), gone, " "), " +", " "))
    return F.when(F.length(F.regexp_replace(x, " ", "")) >= 4, x)


def verdict(old: str, new: str, similarity: Column, threshold: float) -> Column:
    """'propose', 'ambiguous' or 'skip' for an oriented pair of structs (date, stem, conversation, sender, marker).

    The new one has a later date; both share a conversation or sender, or a name where neither has those; then versions
    that advance, or a near text under one name, propose. Versions that don't advance are ambiguous under one name or
    a near text."""
    of = lambda side, c: F.col(f"{side}.{c}")
    same = lambda c: F.coalesce((of(old, c) == of(new, c)) & (of(new, c) != ""), F.lit(False))
    mail = lambda side: (F.coalesce(of(side, "conversation"), F.lit("")) != "") | (F.coalesce(of(side, "sender"), F.lit("")) != "")
    newer = F.coalesce((of(old, "date") != "") & (of(new, "date") > of(old, "date")), F.lit(False))
    name, near = same("stem"), F.coalesce(similarity >= threshold, F.lit(False))
    family = same("conversation") | same("sender") | (name & ~mail(old) & ~mail(new))
    marked = of(old, "marker").isNotNull() & of(new, "marker").isNotNull()
    ahead = F.coalesce(marked & (of(old, "marker.scale") == of(new, "marker.scale")) & (of(new, "marker.n") > of(old, "marker.n")), F.lit(False))
    return F.when(~newer | ~family, "skip").when(marked & ~ahead & (name | near), "ambiguous").when(ahead | (name & near), "propose").otherwise("skip")


def candidates(notes: DataFrame, *, threshold: float = 0.95, cutoff: str = "", partners: int = PARTNERS) -> DataFrame:
    """(old, new, committed, place, similarity, verdict): each new note with its newest partners of a shared key.

    notes (id, date, committed, stem, conversation, sender, marker, retired, has_predecessor, body_sha, vector). All
    notes of a block have the same newest partners, so a block sends only its first partners + 1 into the join: no pairs
    within a group, however large it is. Notes with a conversation or sender are blocked by those, others by name."""
    mail = (F.coalesce("conversation", F.lit("")) != "") | (F.coalesce("sender", F.lit("")) != "")
    key = lambda c: F.struct(F.lit(c).alias("kind"), F.col(c).alias("value"))
    keys = F.when(mail, F.array(key("conversation"), key("sender"))).otherwise(F.array(key("stem")))
    blocked = notes.select("id", "date", "committed", F.explode(F.filter(keys, lambda k: F.coalesce(k["value"], F.lit("")) != "")).alias("block"))
    newest = Window.partitionBy("block").orderBy(F.desc("date"), F.desc("committed"), F.desc("id"))
    heads = blocked.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= partners + 1).select("block", F.col("id").alias("partner"), F.col("date").alias("d"), F.col("committed").alias("c"))
    fresh = notes.filter(~F.coalesce("retired", F.lit(False)) & (F.col("committed") >= cutoff)).select("id")
    each = blocked.join(fresh, "id", "left_semi").join(heads, "block").filter("partner <> id").select("id", "committed", "partner", "d", "c").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("d"), F.desc("c"), F.desc("partner")))
    each = each.withColumn("place", place).filter(F.col("place") <= partners).select("id", "committed", "partner", "place")
    side = F.struct("id", "date", "stem", "conversation", "sender", "marker", "retired", "has_predecessor", "body_sha", "vector")
    rows = each.join(notes.select("id", side.alias("x")), "id").join(notes.select(F.col("id").alias("partner"), side.alias("y")), "partner")
    late = F.col("x.date") >= F.col("y.date")
    rows = rows.select("committed", "place", F.col("id").alias("asked"), F.coalesce(F.col("y.retired"), F.lit(False)).alias("gone"), F.when(late, F.col("y")).otherwise(F.col("x")).alias("old"), F.when(late, F.col("x")).otherwise(F.col("y")).alias("new"))
    rows = rows.filter(~F.col("gone") & ~F.coalesce("new.has_predecessor", F.lit(False)) & ~F.coalesce(F.col("old.body_sha") == F.col("new.body_sha"), F.lit(False)))
    norm = F.sqrt(dot("old.vector", "old.vector") * dot("new.vector", "new.vector"))
    sim = F.round(F.when(norm > 0, dot("old.vector", "new.vector") / norm), 6)
    rows = rows.withColumn("similarity", sim)
    return rows.withColumn("verdict", verdict("old", "new", F.col("similarity"), threshold)).select(F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"), "asked", "committed", "place", "similarity", "verdict")


def generate(pairs: DataFrame, *, exclude: tuple[tuple[str, str], ...] = (), most: int = PAIRS) -> list[dict]:
    """One run over candidates, the last committed first: a note is proposed once, and `most` pairs are looked at.

    The cut is the run's own; rows come to the driver one after the other until it is reached."""
    seen, proposed, out, looked = set(map(frozenset, exclude)), set(), [], 0
    for r in pairs.orderBy(F.desc("committed"), F.desc("asked"), "place").toLocalIterator():
        pair = frozenset((r["old_id"], r["new_id"]))
        if pair in seen or pair & proposed:
            continue
        if looked >= most:
            break
        looked += 1
        seen.add(pair)
        if r["verdict"] != "skip":
            out.append({"old_id": r["old_id"], "new_id": r["new_id"], "verdict": r["verdict"], "similarity": r["similarity"]})
        if r["verdict"] == "propose":
            proposed |= pair
    return out
