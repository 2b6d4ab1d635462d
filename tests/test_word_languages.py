"""Languages of words, told in Python by batch, against the native expressions that define them."""

import unicodedata

from colloquy.functions import text as tx
from colloquy.operators import transcript as tr
from pyspark.sql import functions as F


def test_every_letter_has_the_language_of_its_script(spark):
    ids = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343")
    chars = ids.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"[\p{L}\p{M}]").alias("letter"))
    words = chars.select("letter", F.explode(F.array("c", F.concat(F.lit("na"), "c", F.lit("hi")), F.concat(F.lit("\u0915\u0b15a"), "c"))).alias("w"), "c")
    native = tx.word_language(F.col("w"), tx.script_of(F.col("w")))
    seen = words.select("c", "letter", "w", native.alias("want"), tx.word_language(F.col("w")).alias("got"))
    odd = seen.filter(~F.col("want").eqNullSafe(F.col("got"))).collect()
    # Java's table of characters may be older than Python's.
    assert [(r.w, r.want, r.got) for r in odd if r.letter == (unicodedata.category(r.c)[0] in "LM")] == []


def test_counts_of_a_text_are_those_of_its_words_without_a_row_for_each(spark):
    spaces = [chr(c) for c in range(1, 0x3001) if not 0xD800 <= c <= 0xDFFF and (chr(c).isspace() or unicodedata.category(chr(c))[0] in "ZC")]
    texts = [None, "", " \t", "hai ha-in NAHI, mu \u0915\u093f the 12 ... \u0b15 \u0431", *(f"nahi{c}mu{c}the" for c in spaces), "k\u212aya \u0130 caf\xe9 nahi\u0301"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id long, text string, language string")
    words = tr.tagged_words(rows, ["id"]).withColumn("word_language", tx.word_language(F.col("word"), F.col("script")))
    want = words.filter("word_language IS NOT NULL").groupBy("id", "word_language").agg(F.count("*").alias("n"))
    counts = tr.tagged_counts(rows, ["id"])
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    # Ids that are not unique count together, as words did.
    twice = rows.unionByName(rows.filter("id = 3").withColumn("text", F.lit("hai hai")))
    mixed = lambda w: sorted(map(tuple, tr.code_mix(w, twice, ["id"]).collect()), key=str)
    assert mixed(tr.tagged_counts(twice, ["id"])) == mixed(tr.tagged_words(twice, ["id"]))
    # Tags are those of the join that this replaces, and texts are read once.
    both = twice.join(tr.code_mix(tr.tagged_words(twice, ["id"]), twice, ["id"]), "id", "left")
    tagged = tr.tag_segments(twice, ["id"])
    assert tagged.columns == both.columns and sorted(map(tuple, tagged.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = tr.tag_segments(rows, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "regexp" not in plan
