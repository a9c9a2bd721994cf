"""claimweave: reconciling scoped claims across documents, as Spark DataFrame plans."""
