"""op8: all documents encoded, written bit-packed, read back. SQL has no tokenizer: tests compare with the library."""

from loamwork.llm.shared import table
from loamwork.llm.tokenfiles import read_corpus, write_corpus

TOKENIZER, VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2


def query(spark, sf_dir):
    import public_tokenizers

    files = write_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID, VOCABULARY)
    return read_corpus(spark, files)
