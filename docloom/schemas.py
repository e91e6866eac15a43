"""Schemas of the tables the engine works on. Optional keys are nullable columns."""

GRID = "ARRAY<ARRAY<STRING>>"
CELL = "STRUCT<r:INT,c:INT,rs:INT,cs:INT,text:STRING,hdr:BOOLEAN>"
FIELD = "STRUCT<bits:STRING,name:STRING,desc:STRING,access:STRING,reset:STRING>"
BLOCKS = f"doc_id STRING, block_ix BIGINT, kind STRING, text STRING, page INT, level INT, sec STRING, title STRING, table_id STRING, grid {GRID}, spans BOOLEAN, cells ARRAY<{CELL}>"
CHUNKS = "doc_id STRING, rowid BIGINT, file STRING, line INT, page INT, section STRING, kind STRING, tid STRING, text STRING"
HEADINGS = "doc_id STRING, block_ix BIGINT, sec STRING, title STRING, level INT, page INT, file STRING, line INT"
REGISTERS = f"doc_id STRING, name STRING, peripheral STRING, offset STRING, reset STRING, address STRING, section STRING, page INT, page_end INT, block_ix BIGINT, title STRING, family STRING, derived BOOLEAN, confidence STRING, table_id STRING, fields ARRAY<{FIELD}>"
MEMMAP = "doc_id STRING, ix BIGINT, name STRING, base STRING, `end` STRING, bus STRING, page INT, section STRING, source STRING, `desc` STRING"
PAGE_TEXT = "doc_id STRING, page INT, text STRING"
DOCS = "id STRING, title STRING, kind STRING, source STRING, sha256 STRING, pages INT, page_range ARRAY<INT>, profile STRING, built STRING, convert_seconds DOUBLE, grades MAP<STRING,STRING>, low_pages ARRAY<INT>, counts MAP<STRING,STRING>, verify MAP<STRING,INT>"
QUESTIONS = "id STRING, category STRING, question STRING, must STRING"
RESULTS = "id STRING, category STRING, mode STRING, correct INT, cited INT, missing STRING, turns INT, cost_usd DOUBLE, tokens_total BIGINT, tokens_input_uncached BIGINT, tokens_cache_read BIGINT, tokens_output BIGINT, wall_s DOUBLE, error INT, denied STRING, answer STRING"
FIGURES = "fid STRING, page STRING, section STRING, file STRING, caption STRING, labels STRING"
