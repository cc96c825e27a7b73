"""op3: main text of all pages. Not expressible in SQL: tests use pages whose article is known, with unmarked menus and misleading names too."""

from loamwork.llm.html import extract
from loamwork.llm.shared import table


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
