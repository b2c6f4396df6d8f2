"""quillhawk: similarity retrieval over text, image and audio collections on Spark DataFrames."""
