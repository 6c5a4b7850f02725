"""All registered queries and their SQL twins."""

from ridgeline.plans import catalog, documents, extended, figures, queues, readers, review, stores

QUERIES = catalog.QUERIES | extended.QUERIES | review.QUERIES | stores.QUERIES | documents.QUERIES | figures.QUERIES | readers.QUERIES | queues.QUERIES
SQL = catalog.SQL | extended.SQL | review.SQL | stores.SQL | documents.SQL | figures.SQL | readers.SQL | queues.SQL
