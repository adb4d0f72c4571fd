"""Table layouts of the engine."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "docs": "doc_id string, filepath string, fulltext string, fulltext_cat array<array<string>>, author string, accession string, type string, title string, journal string, citation string, year string, abstract string, corpora array<string>, document_type string",
    "sentences": "doc_id string, sentence_id int, begin int, end int, sentence string, sentence_cat array<array<string>>, document_type string",
    "postings": "granularity string, case_mode string, field string, term string, doc_id string, sentence_id int, tf int, positions array<int>",
    "unit_stats": "granularity string, case_mode string, field string, doc_id string, sentence_id int, n_terms int",
    "term_stats": "granularity string, case_mode string, field string, term string, df bigint",
    "lexicon": "term string, category string",
    "category_edges": "parent string, child string",
    "category_ancestors": "category string, ancestor string",
    "stopwords": "word string",
    "annotations": "doc_id string, type string, begin int, end int, content string, value string, term string, category string, tagtype string",
    "text_elements": "page int, seq int, x double, y double, dx double, dy double, font string, font_size double, width double, n_chars int, n_spaces int, text string",
    "links": "page int, uri string, left double, bottom double, width double, height double",
    "bib": "path string, author string, accession string, type string, title string, journal string, citation string, year string, abstract string",
    "search_hits": "identifier string, score double, year string, document_type string, matching_sentences array<struct<sentence_id:int, score:double>>",
    "similarity": "i bigint, j bigint, cos double",
    "components": "node bigint, component bigint",
}
SCHEMAS: dict[str, StructType] = {k: StructType.fromDDL(v) for k, v in _DDL.items()}
#: Defaults of a document's bibliographic columns when nothing is known.
MISSING = {"accession": "Not available", "type": "Not available", "journal": "Not available", "author": "Not available", "title": "Not available", "abstract": "Abstract is not available", "fulltext": "Not available"}
