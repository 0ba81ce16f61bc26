"""inkfold: page-reading, corpus-run and contribution jobs as Spark DataFrame operators."""
