"""The queries of this package: name -> (query, SQL or None)."""

from pipecheck.llm import conversations, decontamination, extraction, language, line_dedup, manifest, mixing, near_dedup, ngram_join, quality, toxicity, url_filter, warc

QUERIES = {
    **decontamination.QUERIES,
    **extraction.QUERIES,
    **mixing.QUERIES,
    **url_filter.QUERIES,
    **warc.QUERIES,
    **quality.QUERIES,
    **language.QUERIES,
    **line_dedup.QUERIES,
    **ngram_join.QUERIES,
    **toxicity.QUERIES,
    **near_dedup.QUERIES,
    **conversations.QUERIES,
    **manifest.QUERIES,
}
