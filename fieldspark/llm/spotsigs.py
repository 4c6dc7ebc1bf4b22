"""Document fingerprints from chains of content words behind common words.

An anchor is a common word; so that texts without any have anchors too, a fixed share
of all other words, picked by a hash of the word, are anchors as well. Every anchor
makes a signature of itself and the next content words, whatever anchors stand
between them. A document's fingerprint is the set of its signatures.

Fingerprints are compared by Jaccard similarity. Sets of too different a size cannot
be similar: pairs are looked for among sets of neighbouring length classes only, and
each set shows only as many of its signatures, rarest first, as a similar one must
share with it. Everything runs on DataFrame functions.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.common import ids_and_texts, let
from fieldspark.operators.ranking import sorted_rank
from fieldspark.storage import cut_lineage, new_path

# The most common words of English, French, German and Spanish: fixed values.
COMMON_WORDS = (
    "the of and to in a is that it for as with was be by on are this or at from "
    "de la le et les des un une du en que est dans pour qui sur au "
    "der die und das ist von den mit zu ein eine nicht im für auf sich dem "
    "el los las del y por con para es se una lo su"
).split()
HASHED_SHARE = 8
NO_ID = -(2**63)
CHAIN = 2


def _is_anchor(word):
    return word.isin(*COMMON_WORDS) | (F.pmod(F.xxhash64(word), F.lit(HASHED_SHARE)) == 0)


def signatures(text, chain=CHAIN):
    """Sorted distinct signatures of a text column, 32 bits each. A text too short
    for any has one signature of all its words, a text without words has none."""
    split = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    numbered = F.transform(split, lambda w, i: F.struct(w.alias("w"), i.alias("i"), _is_anchor(w).alias("a")))

    def chains(words):
        content = F.transform(F.filter(words, lambda x: ~x["a"]), lambda x: x["w"])
        anchors = F.filter(words, lambda x: x["a"])
        return let(
            content,
            lambda c: F.filter(
                F.transform(
                    anchors,
                    # As many content words stand before an anchor as its place less
                    # the anchors before it.
                    lambda x, t: F.when(
                        x["i"] - t + chain <= F.size(c),
                        F.hash(x["w"], *[F.get(c, x["i"] - t + k) for k in range(chain)]),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    def of_words(words):
        return let(
            chains(words),
            lambda s: F.when(F.size(s) > 0, s)
            .when(F.size(words) > 0, F.array(F.hash(F.transform(words, lambda x: x["w"]))))
            .otherwise(s),
        )

    return F.array_sort(F.array_distinct(let(numbered, of_words)))


def as_text(signature_set):
    """A set of signatures as text: eight hexadecimal digits each."""
    return F.array_join(
        F.transform(signature_set, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")),
        "",
    )


def pruned_jaccard(a, b, least=0.0):
    """Jaccard similarity of two signature sets, 0 where sizes rule out ``least``;
    1 for two empty sets."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0)).otherwise(exact)


def compare_with_edit(docs):
    """Fingerprints of every document and of its edit, and how alike they are.

    The edit replaces the last quarter of the code points (rounded down) by as many
    from the start of the next document in the order of ids (after the last one the
    first). ``doc_id, n_chars, edited, signatures, edited_signatures, near_edited,
    near_next``.

    A null text is empty; a null id is the first. Rows that repeat both id and text
    count once; rows that repeat an id alone follow each other. The only document of
    a table is its own next one. An empty table gives an empty result.
    """
    # A key without nulls: equal keys then need no second exchange of the texts.
    texts = ids_and_texts(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("mark"), "text"
    )
    order = cut_lineage(
        texts.select("key", "mark", F.length("text").cast("long").alias("n")).distinct()
    )
    ranked = sorted_rank(order, ["key", "mark"], "rank", "total")
    before = ranked.select(
        F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"),
        F.col("key").alias("before_key"),
        F.col("mark").alias("before_mark"),
        F.floor(F.col("n") / 4).cast("int").alias("wanted"),
    )
    placed = ranked.join(before, "rank").drop("rank", "total", "n")
    # The signatures are computed once, before the rows are dealt out by document;
    # both uses below read that one exchange.
    known = texts.withColumn("signatures", signatures(F.col("text")))
    one = (
        known.withColumn("_n", F.row_number().over(W.partitionBy("key", "mark").orderBy("key")))
        .where("_n = 1")
        .drop("_n")
    )
    following = one.join(placed, ["key", "mark"]).select(
        F.col("before_key").alias("key"),
        F.col("before_mark").alias("mark"),
        F.substring("text", F.lit(1), F.col("wanted")).alias("start"),
        F.col("signatures").alias("next_signatures"),
    )
    both = one.join(following, ["key", "mark"])
    n = F.length("text")
    edited = both.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "start").alias("edited"),
        "signatures",
        "next_signatures",
    ).withColumn("edited_signatures", signatures(F.col("edited")))
    return edited.withColumns(
        {
            "near_edited": pruned_jaccard(F.col("signatures"), F.col("edited_signatures")),
            "near_next": pruned_jaccard(F.col("signatures"), F.col("next_signatures")),
        }
    ).drop("next_signatures")


def similar_sets(docs, least=0.8):
    """Pairs of different signature sets with a similarity of ``least`` or more, by the
    smallest id of each set: ``a, b, similarity``; copies are not expanded.

    Sets are dealt to the length class of their size and the next one, and by their
    rarest signatures; a signature's rarity is its number of sets.
    """
    sets = (
        ids_and_texts(docs)
        .where("doc_id IS NOT NULL")
        .select("doc_id", signatures(F.col("text")).alias("s"))
        .where(F.size("s") > 0)
        .groupBy("s")
        .agg(F.min("doc_id").alias("id"))
        .withColumn("key", F.xxhash64("s"))
    )
    path = new_path(docs.sparkSession, "signature-sets")
    sets.write.parquet(path)
    sets = docs.sparkSession.read.parquet(path)
    single = sets.select("key", F.size("s").alias("n"), F.explode("s").alias("x"))
    rarity = single.groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    order = W.partitionBy("key").orderBy("f", "x")
    length_class = F.floor(F.log(F.col("n")) / math.log(1 / least)).cast("int")
    shown = (
        single.join(rarity, "x")
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
        .select("key", "n", "x", length_class.alias("c"))
    )
    right = shown.select(
        F.col("key").alias("b"), F.col("n").alias("m"), "x", F.explode(F.array("c", F.col("c") - 1)).alias("c")
    )
    pairs = (
        shown.withColumnRenamed("key", "a")
        .join(right, ["x", "c"])
        .where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
        .where(F.col("n") >= least * F.col("m"))
        .select("a", "b")
        .distinct()
    )
    one, other = (
        sets.select(F.col("key").alias(k), F.col("id").alias(f"id_{k}"), F.col("s").alias(f"s_{k}")) for k in "ab"
    )
    return (
        pairs.join(one, "a")
        .join(other, "b")
        .select(
            F.col("id_a").alias("a"),
            F.col("id_b").alias("b"),
            pruned_jaccard(F.col("s_a"), F.col("s_b"), least).alias("similarity"),
        )
        .where((F.col("similarity") >= least) & (F.col("a") != F.col("b")))
    )
