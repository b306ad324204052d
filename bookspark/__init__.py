"""bookspark: a PySpark-native engine for collections of books and marked-up documents."""

__version__ = "0.1.0"
