"""Training-data operators: mixing, tokenising, chat formatting, language
model scoring, vector search, licence scans, near-duplicates, quality rules,
HTML extraction and language identification.

Nothing outside this package imports it; its queries are registered in
``parley.llm.queries``.
"""
