"""ripplebed: preprocessing of multichannel recordings and training texts on Spark."""
