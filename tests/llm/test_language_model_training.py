"""The language model's training reads every training document."""

from __future__ import annotations

import numpy as np

from tidemark.llm import language_model as LM
from tidemark.llm.common import fold
from pyspark.sql import functions as F


def test_every_training_document_reaches_the_network(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(120))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter(fold(F.col("doc_id")) != LM.HELD_OUT)
    lex = LM.lexicon(LM.token_counts(docs))
    untrained = LM.GRU(lex.mass).flat()
    for (i,) in docs.select("doc_id").collect():
        assert not np.array_equal(LM.train(docs.filter(F.col("doc_id") == i), lex, rounds=1), untrained), i
