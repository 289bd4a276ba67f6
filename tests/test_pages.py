"""Markdown: what is a heading, tables of contents, snippets."""

from pyspark.sql import functions as F

from evenkeel.functions import pages

TEXT = """lead *in* with [a link](http://x)

# Title #
Some `code` and
> - quoted **item**
```python
# no heading
~~~
## nor this
```
## Same
| a | b |
|---|:-:|
| 1 | 2 |
~~~~
```
# no
~~~
~~~~~
### Under [same](#x)
1. one
#hash is text
## Same
##
``` not a `fence`
###### Deep
"""


def test_markdown_sections(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "# Only"), (5, "a\r\n# B\r\nc"), (6, "```\n# open to the end")], "page_id int, text string").withColumn("place", F.lit("x"))
    found = pages.markdown_sections(rows).orderBy("page_id", "place").collect()
    mine = [(r.place, r.level, r.heading, r.anchor, r.parent, r.snippet) for r in found if r.page_id == 1]
    assert mine == [
        (0, 0, "", "", None, "lead in with a link"),
        (1, 1, "Title", "title", None, "Some code and quoted item # no heading ## nor this"),
        (2, 2, "Same", "same", 1, "a b 1 2 # no"),
        (3, 3, "Under same", "under-same-x", 2, "one #hash is text"),
        (4, 2, "Same", "same-2", 1, ""),
        (5, 2, "", "section", 1, "not a fence"),
        (6, 6, "Deep", "deep", 5, ""),
    ]
    assert [(r.page_id, r.heading, r.snippet) for r in found if r.page_id > 1] == [(4, "Only", ""), (5, "", "a"), (5, "B", "c"), (6, "", "# open to the end")]
    toc = pages.contents(pages.markdown_sections(rows.where("page_id = 1"))).orderBy("place").collect()
    assert [(r.level, r.anchor) for r in toc] == [(2, "same"), (3, "under-same-x"), (2, "same-2"), (2, "section")]
