"""Every operator as a query over the given tables, each with an independent SQL form."""
