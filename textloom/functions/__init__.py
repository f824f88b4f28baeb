"""Column functions; none needs Python workers except where its name says so."""
