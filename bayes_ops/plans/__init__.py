"""Model plans: sufficient statistics -> posterior, as DataFrame plans."""
