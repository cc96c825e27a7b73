"""op7: quality scores of all documents. Not expressible in SQL: tests look at held-out labels."""

from loamwork.llm.nbsvm import classify
from loamwork.llm.shared import table


def query(spark, sf_dir):
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
