"""Binary images as tables: decoders, codecs and relational operators on Spark DataFrames."""
