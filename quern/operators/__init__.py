"""Read and write operators on collections."""
