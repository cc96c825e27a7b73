"""op1: fingerprints of all documents and of their edited texts. SQL has no NFKC, so tests compare with a plain Python version."""

from loamwork.llm.fingerprint import edited_report
from loamwork.llm.shared import table


def query(spark, sf_dir):
    return edited_report(table(spark, sf_dir, "documents"))
