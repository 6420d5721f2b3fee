"""DataFrame -> DataFrame operators (sections P, C, A, W, G, J, T, M)."""
