"""op4: candidates for secrets in all documents, with the forest's verdict. Not expressible in SQL: tests use planted secrets."""

from loamwork.llm.secrets import findings
from loamwork.llm.shared import table


def query(spark, sf_dir):
    return findings(table(spark, sf_dir, "documents"))
