"""All queries of this subpackage and the SQL of those that SQL can express."""

from llm import queries_more, queries_pack, queries_text, queries_trees

QUERIES = {**queries_more.QUERIES, **queries_text.QUERIES, **queries_pack.QUERIES, **queries_trees.QUERIES}
SQL = {**queries_more.SQL, **queries_text.SQL, **queries_pack.SQL, **queries_trees.SQL}
