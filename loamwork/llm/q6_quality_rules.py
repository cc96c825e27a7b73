"""op6: base counts of all documents, and the robust outlier verdict. Not expressible in SQL: tests compare kept with a plain numpy version."""

from loamwork.llm.robust import quality_rules
from loamwork.llm.shared import table


def query(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
