"""Corpus-preparation operators. Nothing else in webweft imports this package."""
