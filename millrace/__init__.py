"""millrace: a PySpark-native engine for collections of postings and documents."""
