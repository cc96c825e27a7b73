"""op9: all documents encoded by pieces and decoded again. Not expressible in SQL: tests compare ids with the library's, and round trips."""

from loamwork.llm.pieces import digests
from loamwork.llm.shared import table

MODEL = "piece_bpe_32k.model"


def query(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
