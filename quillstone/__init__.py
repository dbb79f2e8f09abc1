"""quillstone: analytics over court-record corpora, built on PySpark DataFrames."""
