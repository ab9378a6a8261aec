"""Every operator as a query over the given tables, with its SQL check."""

from queries import files, joins, logs, repairs, reports, schemas, scores

REGISTRY = {
    **joins.QUERIES,
    **schemas.QUERIES,
    **logs.QUERIES,
    **reports.QUERIES,
    **scores.QUERIES,
    **files.QUERIES,
    **repairs.QUERIES,
}
