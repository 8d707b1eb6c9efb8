"""Training-data preparation operators (documents, pages, benchmark items)."""
