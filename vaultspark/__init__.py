"""vaultspark: querying and curating knowledge corpora on Spark DataFrames."""
