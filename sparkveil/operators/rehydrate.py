"""Names back from surrogates that a model has misspelt, cased or written in another script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths and distances of fuzzy matches.
FUZZY_LENGTH, FUZZY_LONG = 5, 8


def shortened(word: Column, most: Column) -> Column:
    """word without its first letter and without up to `most` (1 or 2) further letters, each outcome once. Two words that start alike and are within `most` edits have one in common."""
    rest = F.substr(word, F.lit(2))
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.left(w, k - 1), F.substr(w, k + 1)))
    once = less(rest)
    twice = F.when(most > 1, F.flatten(F.transform(once, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(rest), once, twice))


def fuzzy_matches(words: DataFrame, names: DataFrame) -> DataFrame:
    """words(word) against names(surrogate, raw) -> word, raw, distance.

    A word of five letters or more that is no known name word, shares the first letter, and is within one edit
    (two if the name has eight letters or more) of names that all lead to one raw. Words and names meet by an equi-join on the first letter and on what is
    left after up to as many deletions as edits are allowed, so only near words meet, and their distance is then checked. Words of a length that no name allows are left out before.
    """
    known = names.select(F.explode(F.split(F.lower(F.concat_ws(" ", "surrogate", "raw")), r"\s+")).alias("_known")).distinct()
    parts = names.where(F.col("surrogate").rlike(r"^\p{L}{5,}$")).select(F.lower("surrogate").alias("_part"), "raw").distinct()
    parts = parts.withColumn("_most", F.when(F.length("_part") >= FUZZY_LONG, 2).otherwise(1))
    lengths = parts.select(F.explode(F.sequence(F.length("_part") - F.col("_most"), F.length("_part") + F.col("_most"))).alias("_length")).distinct()
    low = words.select("word", F.lower("word").alias("_low")).distinct().where(F.length("_low") >= FUZZY_LENGTH)
    low = low.join(lengths, F.length("_low") == F.col("_length"), "left_semi").join(known, F.col("_low") == F.col("_known"), "left_anti")
    keyed = lambda df, word, most: df.withColumn("_first", F.left(word, F.lit(1))).withColumn("_key", F.explode(shortened(F.col(word), most)))
    a = keyed(low, "_low", F.when(F.length("_low") >= FUZZY_LONG - 2, 2).otherwise(1))
    near = a.join(keyed(parts, "_part", F.col("_most")), ["_first", "_key"]).select("word", "_low", "_part", "raw", "_most").distinct()
    near = near.withColumn("distance", F.levenshtein("_low", "_part")).where("distance BETWEEN 1 AND _most")
    best = near.groupBy("word").agg(F.min(F.struct("distance", "raw")).alias("_best"), F.collect_set(F.struct("distance", "raw")).alias("_all"))
    tie = F.size(F.array_distinct(F.filter("_all", lambda x: x["distance"] == F.col("_best.distance")))) > 1
    return best.where(~tie).select("word", F.col("_best.raw").alias("raw"), F.col("_best.distance").alias("distance"))


# Consonant classes of Devanagari (and, shifted by 0x80, of Bengali) letters.
CLASSES = {
    "K": "कख", "G": "गघ", "N": "ंङञणन", "C": "चछ", "J": "जझ", "T": "टठतथ", "D": "डढदध", "P": "पफ", "B": "बभव",
    "M": "म", "Y": "य", "R": "रऋृ", "L": "लळ", "S": "शषस", "H": "ह", "A": "अआइईउऊऌऍऎएऐऑऒओऔ",
}


def bengali_of(word: Column) -> Column:
    """Devanagari letters moved to the Bengali block (व, which Bengali lacks, to ব)."""
    source = [chr(c) for c in range(0x0901, 0x0940) if c not in (0x0904, 0x0935)] + [chr(c) for c in (*range(0x0940, 0x094E), 0x0935)]
    target = [chr(ord(c) + 0x80) if c != "व" else "ব" for c in source]
    return F.translate(word, "".join(source), "".join(target))


def skeleton(word: Column) -> Column:
    """The consonant classes of an Indic word: vowels only at the start, repeats once; null under three consonants or with other letters."""
    pairs = [(c, k) for k, letters in CLASSES.items() for c in letters]
    source = "".join(c for c, _ in pairs) + "".join(chr(ord(c) + 0x80) for c, _ in pairs)
    target = "".join(k for _, k in pairs) * 2
    classes = F.regexp_replace(F.translate(word, source, target), r"[\x{0900}-\x{0963}\x{0966}-\x{09FF}]", "")
    inner = F.regexp_replace(F.substr(classes, F.lit(2)), "[AY]", "")
    joined = F.regexp_replace(F.concat(F.left(classes, F.lit(1)), inner), r"([B-Z])\1+", "$1")
    return F.when(joined.rlike("^[A-Z]+$") & (F.length(F.replace(joined, F.lit("A"), F.lit(""))) >= 3), joined)


def forms(names: DataFrame, spellings: DataFrame, seen: DataFrame) -> DataFrame:
    """names(surrogate, raw) x spellings(surrogate, form) -> form, raw; forms that lead to several raws, or that the request itself holds (seen: form), are left out."""
    own = spellings.join(names, "surrogate").groupBy("form").agg(F.min("raw").alias("raw"), F.countDistinct("raw").alias("_n")).where("_n = 1").drop("_n")
    return own.join(seen, "form", "left_anti")
