"""Parameters shared by the registered queries and their oracles."""

# Fixed values for the evaluation and detector queries. The synthetic panels
# are independent draws, so a score below 40 is rare (8 labelled rows at
# sf0.01); the evaluation label and the static rule use 50 so that both
# classes occur. The reference's own defaults stay the operator defaults.
EVAL_THRESHOLD = 50.0
SPLIT_DATE = "1998-01-01"
HORIZON = 3
STATIC_MODEL = "Static Threshold"

#: Rows of a segment in the queries that cut series (some 500 to 2,400 rows here).
SEGMENT_ROWS = 200
