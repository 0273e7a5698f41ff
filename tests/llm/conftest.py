import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows that hold copies, near copies, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "ta") for b in ("den", "fox", "gul", "hap", "jib")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    first = text(80)
    near = first.split()
    near[40] = "changed"
    texts = [first, first, " ".join(near), first.upper(), text(60), text(3), text(3), "", None, "   \n ", "one", "one", "123 $$$ 456", text(30_000), "line one is here and long\nline one is here and lang\n" + text(20), "\x00 odd   ﻿ text é 日本"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, first, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def messy(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """Extra columns named as outputs and as inner columns."""
    from pyspark.sql import functions as F

    names = "node copies sig band bucket lo hi block a b n score lang_pred held_out predicted n_words n_tokens copy shuffle_key mix_rate item_id k1 pos line removed".split()
    return messy.withColumns({k: F.lit(1) for k in names})
