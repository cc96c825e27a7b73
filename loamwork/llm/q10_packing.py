"""op10: all documents packed into sequences of 2048 tokens. SQL has no tokenizer: tests compare with the library."""

from loamwork.llm.packing import pack
from loamwork.llm.shared import table

TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 1, 2048


def pack_documents(docs):
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER), END_ID, WINDOW)


def query(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
