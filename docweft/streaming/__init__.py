"""Documents that arrive: each micro-batch is converted as a corpus of its own, since a document refers to nothing outside it."""
